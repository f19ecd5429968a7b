"""HEALPix geometry on NumPy arrays, from the published planar projection.

Longitude and latitude are mapped to the plane (t, v): t counts quarters of a turn, v runs
from -1 to 1 between the poles.  There every base cell is a square standing on a corner, of
unit diagonal, with its x axis to the north-east and its y axis to the north-west.
"""

from __future__ import annotations

import numpy as np

MAX_ORDER = 29
#: Centres (t, v) of the 12 base cells: north, equator, south.
_CELL_T = np.array([0.5, 1.5, 2.5, 3.5, 0.0, 1.0, 2.0, 3.0, 0.5, 1.5, 2.5, 3.5])
_CELL_V = np.repeat([0.5, 0.0, -0.5], 4)


def _spread(x: np.ndarray) -> np.ndarray:
    """Put the bits of a 32-bit number at the even places of a 64-bit one."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    """The inverse of ``_spread``."""
    x = x.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | x >> np.uint64(shift)) & np.uint64(mask)
    return x


def cell_to_xy(order, ipix):
    """(base cell, x, y) of nested pixels."""
    order, ipix = np.asarray(order, np.int64), np.asarray(ipix, np.int64)
    inside = ipix & ((np.int64(1) << (2 * order)) - 1)
    return ipix >> (2 * order), _gather(inside).astype(np.int64), _gather(inside >> 1).astype(np.int64)


def xy_to_cell(order, base, x, y):
    """Nested pixels of (base cell, x, y)."""
    return (np.asarray(base, np.int64) << (2 * np.asarray(order, np.int64))) + (_spread(np.asarray(x)) | _spread(np.asarray(y)) << np.uint64(1)).astype(np.int64)


def _to_plane(z, half, phi):
    """(t, v, base cell of the caps or -1 between them); ``half`` is the sine of half the angle from the nearer pole."""
    t = np.mod(phi, 2 * np.pi) / (np.pi / 2)
    t = np.where(t >= 4, 0.0, t)
    sigma = np.sqrt(6.0) * half  # distance to the nearer pole, 1 at the edge of the cap
    quarter = np.minimum(np.floor(t), 3)
    middle = quarter + 0.5
    cap = np.abs(z) > 2 / 3
    base = np.where(cap, np.where(z > 0, 0, 8) + quarter, -1)
    return np.where(cap, middle + (t - middle) * np.minimum(sigma, 1), t), np.where(cap, np.sign(z) * (1 - sigma / 2), 0.75 * z), base


def _from_plane(t, v):
    sigma = 2 * (1 - np.abs(v))
    cap = np.abs(v) > 0.5
    middle = np.floor(np.mod(t, 4)) + 0.5
    safe = np.where(sigma > 0, sigma, 1)
    turn = np.where(cap, middle + (np.mod(t, 4) - middle) / safe, t)
    half = np.arcsin(np.minimum(1, sigma / np.sqrt(6)))
    theta = np.where(cap, np.where(v > 0, 2 * half, np.pi - 2 * half), np.arccos(np.clip(4 / 3 * v, -1, 1)))
    return theta, np.mod(turn, 4) * (np.pi / 2)


def _plane_to_cell(order, t, v, cap=-1):
    n = (np.int64(1) << np.asarray(order, np.int64)).astype(float)
    a, b = 0.5 + t + v, 0.5 + t - v  # along x; against y
    ia, ib = np.floor(a * n).astype(np.int64), np.floor(b * n).astype(np.int64)
    fa, fb = ia >> np.asarray(order, np.int64), ib >> np.asarray(order, np.int64)
    # a cap's base cell is known by its quarter: on the edges rounding may leave the two in another
    cap = np.where(np.isfinite(cap), cap, -1.0).astype(np.int64)
    north, south = (cap >= 0) & (cap < 4), cap >= 8
    fa, fb = np.where(north, cap + 1, np.where(south, cap - 8, fa)), np.where(north, cap, np.where(south, cap - 7, fb))
    fa = np.where(fa > fb + 1, fb + 1, fa)
    fb = np.where(fb > fa + 1, fa + 1, fb)
    base = np.where(fa == fb, 4 + fa % 4, np.where(fa > fb, fb % 4, 8 + fa % 4))
    size = np.int64(1) << np.asarray(order, np.int64)
    x = np.clip(ia - fa * size, 0, size - 1)
    y = np.clip(size - 1 - (ib - fb * size), 0, size - 1)
    return xy_to_cell(order, base, x, y)


def ang2pix(order, theta, phi):
    """Nested pixel that holds a direction; theta from the north pole, in radians."""
    theta = np.asarray(theta, float)
    z = np.cos(theta)
    return _plane_to_cell(order, *_to_plane(z, np.where(z >= 0, np.sin(theta / 2), np.cos(theta / 2)), np.asarray(phi, float)))


def zphi2pix(order, z, phi):
    """The same by the cosine of theta, which an angle doesn't give back to the last digit on the edges of pixels."""
    z = np.asarray(z, float)
    return _plane_to_cell(order, *_to_plane(z, np.sqrt(3 * (1 - np.abs(z))) / np.sqrt(6.0), np.asarray(phi, float)))


def pix2ang(order, ipix, dx=0.5, dy=0.5):
    """(theta, phi) of a point of nested pixels, by default their centres."""
    base, x, y = cell_to_xy(order, ipix)
    n = (np.int64(1) << np.asarray(order, np.int64)).astype(float)
    fx, fy = (x + dx) / n, (y + dy) / n
    return _from_plane(_CELL_T[base] + (fx - fy) / 2, _CELL_V[base] + (fx + fy - 1) / 2)


def pix2vec(order, ipix, dx=0.5, dy=0.5):
    theta, phi = pix2ang(order, ipix, dx, dy)
    s = np.sin(theta)
    return np.stack([s * np.cos(phi), s * np.sin(phi), np.cos(theta)], axis=-1)


def vec2pix(order, v):
    v = np.asarray(v, float)
    return ang2pix(order, np.arctan2(np.hypot(v[..., 0], v[..., 1]), v[..., 2]), np.arctan2(v[..., 1], v[..., 0]))


def _ring_layout(order, ring):
    """(pixels in a quarter of the ring, whether it is shifted by half a pixel, pixels before it)."""
    n = np.int64(1) << np.asarray(order, np.int64)
    ring = np.asarray(ring, np.int64)
    quarter = np.minimum(np.minimum(ring, 4 * n - ring), n)
    north, south = ring < n, ring > 3 * n
    before = np.where(north, 2 * ring * (ring - 1), np.where(south, 12 * n * n - 2 * quarter * (quarter + 1), 2 * n * (n - 1) + (ring - n) * 4 * n))
    shifted = np.where(north | south, True, (ring - n) % 2 == 0)
    return quarter, shifted, before


def nest2ring(order, ipix):
    base, x, y = cell_to_xy(order, ipix)
    n = np.int64(1) << np.asarray(order, np.int64)
    ring = (2 * n * (1 - _CELL_V[base])).astype(np.int64) + n - (x + y + 1)
    quarter, shifted, before = _ring_layout(order, ring)
    # pixel centres lie at (place + 1/2) / quarter where shifted, else at place / quarter
    twice = (2 * _CELL_T[base]).astype(np.int64) * quarter + x - y
    place = np.where(shifted, (twice - 1) // 2, twice // 2)
    return before + np.mod(place, 4 * quarter)


def ring_of(order, ring_pix):
    """Number of the ring (from 1 in the north) of RING pixels."""
    n = np.int64(1) << np.asarray(order, np.int64)
    p = np.asarray(ring_pix, np.int64)
    cap = 2 * n * (n - 1)
    def first(k):  # ring in a cap that holds its k-th pixel
        r = np.floor((1 + np.sqrt(1 + 2 * np.maximum(k, 0).astype(float))) / 2).astype(np.int64)
        r = np.where(2 * r * (r - 1) > k, r - 1, r)
        return np.where(2 * r * (r + 1) <= k, r + 1, r)
    last = 12 * n * n - 1 - p
    return np.where(p < cap, first(p), np.where(last < cap, 4 * n - first(last), (p - cap) // (4 * n) + n))


def ring2nest(order, ring_pix):
    n = np.int64(1) << np.asarray(order, np.int64)
    ring = ring_of(order, ring_pix)
    quarter, shifted, before = _ring_layout(order, ring)
    turn = (np.asarray(ring_pix, np.int64) - before + np.where(shifted, 0.5, 0.0)) / quarter
    v = 1 - ring / (2.0 * n)
    middle = np.floor(turn) + 0.5
    cap = (ring < n) | (ring > 3 * n)
    t = np.where(cap, middle + (turn - middle) * quarter / n, turn)
    return _plane_to_cell(order, t, v)


#: The eight directions around a pixel, from the south-west on clockwise: steps of (x, y).
DIRECTIONS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def neighbours(order, ipix):
    """(..., 8) nested neighbours in the order of ``DIRECTIONS``; -1 where three base cells meet."""
    base, x, y = cell_to_xy(order, ipix)
    n = np.int64(1) << np.asarray(order, np.int64)
    zone, k = base // 4, base % 4
    out = []
    for dx, dy in DIRECTIONS:
        u, w = x + dx, y + dy
        east, west, up, down = u >= n, u < 0, w >= n, w < 0
        b, p, q = base.copy(), np.clip(u, 0, n - 1), np.clip(w, 0, n - 1)
        gone = np.zeros(base.shape, bool)

        def cross(where, at, to_zone, to_k, new_x, new_y):
            m = where & (zone == at)
            b[m] = (to_zone * 4 + np.mod(k + to_k, 4))[m] if isinstance(to_zone, np.ndarray) else to_zone * 4 + np.mod(k[m] + to_k, 4)
            p[m], q[m] = np.broadcast_to(new_x, base.shape)[m], np.broadcast_to(new_y, base.shape)[m]

        end, zero = n - 1, np.zeros_like(x)
        edge = east & ~up & ~down  # over the north-east side
        cross(edge, 0, 0, 1, w, end), cross(edge, 1, 0, 0, zero, w), cross(edge, 2, 1, 1, zero, w)
        edge = up & ~east & ~west  # north-west
        cross(edge, 0, 0, -1, end, u), cross(edge, 1, 0, -1, u, zero), cross(edge, 2, 1, 0, u, zero)
        edge = west & ~up & ~down  # south-west
        cross(edge, 0, 1, 0, end, w), cross(edge, 1, 2, -1, end, w), cross(edge, 2, 2, -1, w, zero)
        edge = down & ~east & ~west  # south-east
        cross(edge, 0, 1, 1, u, end), cross(edge, 1, 2, 0, u, end), cross(edge, 2, 2, 1, zero, u)
        corner = east & up
        cross(corner, 0, 0, 2, end, end), cross(corner, 2, 0, 0, zero, zero)
        gone |= corner & (zone == 1)
        corner = west & down
        cross(corner, 0, 2, 0, end, end), cross(corner, 2, 2, 2, zero, zero)
        gone |= corner & (zone == 1)
        corner = east & down
        cross(corner, 1, 1, 1, zero, end)
        gone |= corner & (zone != 1)
        corner = west & up
        cross(corner, 1, 1, -1, end, zero)
        gone |= corner & (zone != 1)
        out.append(np.where(gone, -1, xy_to_cell(order, b, p, q)))
    return np.stack(out, axis=-1)


def interpolation(order, theta, phi):
    """((..., 4) nested pixels, (..., 4) weights): linear in longitude within two rings, then in z between them.

    Above the first and below the last ring the opposite pixels of that ring take the second place.
    """
    theta, phi = np.asarray(theta, float), np.mod(np.asarray(phi, float), 2 * np.pi)
    n = np.int64(1) << np.int64(order)
    z = np.cos(theta)

    def height(ring):  # cosine of a ring's colatitude
        v = 1 - ring / (2.0 * n)
        sigma = 2 * (1 - np.abs(v))
        return np.where(np.abs(v) > 0.5, np.sign(v) * (1 - sigma**2 / 3), 4 / 3 * v)

    v = np.where(np.abs(z) > 2 / 3, np.sign(z) * (1 - np.sqrt(3 * (1 - np.abs(z))) / 2), 0.75 * z)
    upper = np.clip(np.floor(2 * n * (1 - v)), 0, 4 * n - 1).astype(np.int64)
    lower = upper + 1

    def in_ring(ring):
        quarter, shifted, before = _ring_layout(order, np.clip(ring, 1, 4 * n - 1))
        where = phi / (2 * np.pi) * 4 * quarter - np.where(shifted, 0.5, 0.0)
        left = np.floor(where).astype(np.int64)
        part = where - left
        pix = [ring2nest(order, before + np.mod(left + k, 4 * quarter)) for k in (0, 1)]
        return pix, (1 - part, part), (before, quarter, left)

    (u0, u1), (a0, a1), (bu, qu, lu) = in_ring(upper)
    (d0, d1), (b0, b1), (bd, qd, ld) = in_ring(lower)
    zu = np.where(upper < 1, 1.0, height(np.maximum(upper, 1)))
    zd = np.where(lower > 4 * n - 1, -1.0, height(np.minimum(lower, 4 * n - 1)))
    down = (zu - z) / (zu - zd)
    # beyond the first or last ring: all four pixels of that ring share the pole's part
    top, bottom = upper < 1, lower > 4 * n - 1
    w = [a0 * (1 - down), a1 * (1 - down), b0 * down, b1 * down]
    pole_up, pole_down = (1 - down) / 4, down / 4
    u0 = np.where(top, ring2nest(order, bd + np.mod(ld + 2, 4)), u0)
    u1 = np.where(top, ring2nest(order, bd + np.mod(ld + 3, 4)), u1)
    d0 = np.where(bottom, ring2nest(order, bu + np.mod(lu + 2, 4)), d0)
    d1 = np.where(bottom, ring2nest(order, bu + np.mod(lu + 3, 4)), d1)
    w[0], w[1] = np.where(top, pole_up, w[0]), np.where(top, pole_up, w[1])
    w[2] = np.where(top, w[2] + pole_up, np.where(bottom, pole_down, w[2]))
    w[3] = np.where(top, w[3] + pole_up, np.where(bottom, pole_down, w[3]))
    w[0], w[1] = np.where(bottom, w[0] + pole_down, w[0]), np.where(bottom, w[1] + pole_down, w[1])
    return np.stack([u0, u1, d0, d1], axis=-1), np.stack(w, axis=-1)
