"""Polygons on the sphere: subdivision, cuts at the date line and prime meridian, simplification."""

from __future__ import annotations

import heapq

import numpy as np


def to_vectors(vertices):
    v = np.asarray(vertices, float)
    return np.stack([np.cos(v[:, 1]) * np.cos(v[:, 0]), np.cos(v[:, 1]) * np.sin(v[:, 0]), np.sin(v[:, 1])], axis=1)


def to_angles(x):
    return np.stack([np.mod(np.arctan2(x[:, 1], x[:, 0]), 2 * np.pi), np.arctan2(x[:, 2], np.hypot(x[:, 0], x[:, 1]))], axis=1)


def subdivide(vertices, longest: float):
    """Insert points so that no side is longer, in longitude or latitude; sides are straight in both."""
    v = np.asarray(vertices, float)
    out = []
    for a, b in zip(v, np.roll(v, -1, axis=0)):
        d = b - a
        d[0] = np.mod(d[0] + np.pi, 2 * np.pi) - np.pi
        n = max(1, int(np.ceil(np.abs(d).max() / longest)))
        out += [a + d * k / n for k in range(n)]
    return np.array(out)


def _clip(points, keep, where):
    """Sutherland-Hodgman step: the part of a planar polygon with keep(x) >= 0."""
    out = []
    for a, b in zip(points, np.roll(points, -1, axis=0)):
        if keep(a) >= 0:
            out.append(a)
        if keep(a) * keep(b) < 0:
            t = keep(a) / (keep(a) - keep(b))
            p = a + t * (b - a)
            p[0] = where
            out.append(p)
    return np.array(out)


def _cut(vertices, seam: float):
    """Pieces of a polygon on either side of a meridian, longitudes in [seam, seam + 2 pi]; a pole inside is walked round."""
    v = np.asarray(vertices, float)
    step = np.mod(np.diff(np.append(v[:, 0], v[0, 0])) + np.pi, 2 * np.pi) - np.pi
    lon = v[0, 0] + np.concatenate([[0], np.cumsum(step)])
    if abs(step.sum()) > np.pi:  # winds around a pole: close along it
        pole = np.pi / 2 if v[:, 1].mean() > 0 else -np.pi / 2
        path = np.column_stack([lon, np.append(v[:, 1], v[0, 1])])
        path = np.vstack([path, [lon[-1], pole], [lon[0], pole]])
    else:
        path = np.column_stack([lon[:-1], v[:, 1]])
    out = []
    first = int(np.floor((path[:, 0].min() - seam) / (2 * np.pi)))
    last = int(np.floor((path[:, 0].max() - seam) / (2 * np.pi)))
    for k in range(first, last + 1):
        low = seam + 2 * np.pi * k
        part = _clip(path, lambda p: p[0] - low, low)
        part = _clip(part, lambda p: low + 2 * np.pi - p[0], low + 2 * np.pi) if len(part) else part
        if len(part) >= 3:
            out.append(part - [2 * np.pi * k, 0])
    return out


def cut_dateline(vertices):
    """Pieces with longitudes in [-pi, pi]."""
    return _cut(vertices, -np.pi)


def cut_prime_meridian(vertices):
    """Pieces with longitudes in [0, 2 pi]."""
    return _cut(vertices, 0.0)


def rectangle(width: float, height: float, theta: float, phi: float, longest: float = 0.05):
    """A rectangle of angular width and height around a direction, as (longitude, latitude)."""
    def arc(n):
        return np.linspace(-0.5, 0.5, n)
    n, m = (max(2, int(np.ceil(s / longest)) + 1) for s in (width, height))
    x = np.concatenate([arc(n) * width, np.full(m, width / 2), -arc(n) * width, np.full(m, -width / 2)])
    y = np.concatenate([np.full(n, -height / 2), arc(m) * height, np.full(n, height / 2), -arc(m) * height])
    local = np.stack([-np.sin(y), np.cos(y) * np.sin(x), np.cos(y) * np.cos(x)], axis=1)
    ct, st, cp, sp = np.cos(theta), np.sin(theta), np.cos(phi), np.sin(phi)
    turn = np.array([[ct * cp, -sp, st * cp], [ct * sp, cp, st * sp], [-st, 0, ct]])
    return to_angles(local @ turn.T)


def simplify(vertices, least_area: float):
    """Drop, one after the other, the vertex whose triangle on the sphere is smallest, until all reach ``least_area`` or three are left.

    A heap holds the triangles; one that a neighbour's end has changed is put in anew.
    """
    x = np.asarray(vertices, float)
    n = len(x)
    before, after, turn = [(k - 1) % n for k in range(n)], [(k + 1) % n for k in range(n)], [0] * n

    def area(k):
        a, b, c = x[before[k]], x[k], x[after[k]]
        return abs(2 * np.arctan2(np.dot(a, np.cross(b, c)), 1 + np.dot(a, b) + np.dot(b, c) + np.dot(c, a)))

    heap = [(area(k), k, 0) for k in range(n)]
    heapq.heapify(heap)
    left = n
    while left > 3:
        size, k, when = heapq.heappop(heap)
        if when != turn[k]:
            continue
        if size >= least_area:
            break
        turn[k], left = -1, left - 1
        a, b = before[k], after[k]
        after[a], before[b] = b, a
        for j in (a, b):
            turn[j] += 1
            heapq.heappush(heap, (area(j), j, turn[j]))
    return x[[k for k in range(n) if turn[k] >= 0]]
