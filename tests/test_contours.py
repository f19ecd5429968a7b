"""Rings against a plain walk, simplification, interpolation, and the ellipse's published examples."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.functions import healpix, polygon
from skylattice.operators import contours


def plain_rings(order, region):
    """Walk along the boundary of a set of pixels, by the places of corners."""
    corner = lambda p, d: tuple(np.round(healpix.pix2vec(np.array([order]), np.array([p]), float(d[0]), float(d[1]))[0] * 1e9).astype(int).tolist())
    out, sides = [], {}
    for p in region:
        near = healpix.neighbours(np.array([order]), np.array([p]))[0]
        for k in range(4):
            if near[2 * k] not in region:
                a, b = contours._CORNERS[k], contours._CORNERS[(k + 1) % 4]
                sides[4 * p + k] = (corner(p, a), corner(p, b))
    start = {}
    for i, (a, _) in sides.items():
        start.setdefault(a, []).append(i)
    left = set(sides)
    while left:
        i = first = min(left)
        path = []
        while True:
            path.append(i)
            left.discard(i)
            i = min(start[sides[i][1]], key=lambda j: (j // 4 != i // 4, j))
            if i == first:
                break
        out.append(path)
    return sorted(out)


@pytest.mark.parametrize("inner", [6, 1, 0])
def test_rings_by_a_plain_walk(spark, inner):
    rng, order = np.random.default_rng(0), 2
    value = {m: rng.random(192) for m in range(2)}
    rows = [(m, k, float(v)) for m in value for k, v in enumerate(value[m]) if m == 0 or k % 7]
    df = spark.createDataFrame(rows, "m long, ipix long, cls double").repartition(4)
    got = contours.rings(contours.boundary_edges(df, order, [0.3, 0.8], ["m"]), order, ["m"], inner=inner).collect()
    for m in value:
        for level in (0.3, 0.8):
            want = plain_rings(order, {k for mm, k, v in rows if mm == m and v <= level})
            mine = {}
            for r in got:
                if (r.m, r.level) == (m, level):
                    mine.setdefault(r.ring, {})[r.nth] = 4 * r.ipix + r.side
            assert sorted([x[k] for k in sorted(x)] for x in mine.values()) == want
            assert all(sorted(x) == list(range(len(x))) for x in mine.values())


def test_chains_of_a_block():
    rows = pd.DataFrame({"id": [1, 2, 3, 10, 11, 12], "succ": [2, 3, 99, 12, 10, 11]})
    got = {r.id: r for r in contours._chains(rows).itertuples()}
    assert [got[k].offset for k in (1, 2, 3)] == [0, 1, 2] and got[1].next == 99 and got[1].length == 3 and not got[1].closed
    assert [got[k].offset for k in (10, 12, 11)] == [0, 1, 2] and got[11].closed and got[11].chain == 10


def test_simplification_drops_the_smallest_triangles_first():
    rng = np.random.default_rng(1)
    turn = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    x = np.stack([np.cos(turn) * 0.2, np.sin(turn) * 0.2, np.ones(60)], axis=1) + rng.normal(0, 0.005, (60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def plain(v, least):
        v = list(v)
        area = lambda a, b, c: abs(2 * np.arctan2(np.dot(a, np.cross(b, c)), 1 + np.dot(a, b) + np.dot(b, c) + np.dot(c, a)))
        while len(v) > 3:
            sizes = [area(v[k - 1], v[k], v[(k + 1) % len(v)]) for k in range(len(v))]
            k = int(np.argmin(sizes))
            if sizes[k] >= least:
                break
            del v[k]
        return np.array(v)

    for least in (0, 1e-5, 1e-3, 1.0):
        assert np.allclose(polygon.simplify(x, least), plain(x, least))


def test_contours_after_interpolation(spark):
    order = 2
    theta, phi = healpix.pix2ang(np.full(192, order), np.arange(192))
    p = np.exp(-0.5 * (np.arccos(np.clip(np.sin(theta) * np.cos(phi - 1), -1, 1)) / 0.5) ** 2)
    m = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p / p.sum())], "ipix long, prob double")
    count = lambda **how: sum(len(r) for r in contours.contour(m, order, [0.5], simplify=False, **how).first().polygons)
    near, smooth = count(order_out=4), count(order_out=4, interpolate="bilinear")
    assert near > 4 * count() - 20 and abs(smooth - near) < near
    assert count(interpolate="nested") > 4
    (ring,) = contours.contour(m, order, [0.5], order_out=5, interpolate="bilinear").first().polygons
    far = [np.degrees(np.arccos(np.clip(np.cos(np.radians(q.dec)) * np.cos(np.radians(q.ra) - 1), -1, 1))) for q in ring]
    assert ring[0] == ring[-1] and max(far) - min(far) < 12  # about a circle
    with pytest.raises(ValueError):
        contours.contour(m, order, [0.5], interpolate="cubic")


def gaussian(spark, mean, inverse, order):
    """exp of the quadratic form about ``mean`` at all cells of an order, from Spark's own range."""
    npix = 12 * 4**order
    v = healpix.pix2vec(np.full(npix, order), np.arange(npix)) - np.asarray(mean)
    p = np.exp(-0.5 * np.einsum("ai,ij,aj->a", v, inverse, v))
    p /= p.sum()
    held = np.flatnonzero(p > 1e-12 * p.max())
    return spark.createDataFrame(pd.DataFrame({"ipix": held, "prob": p[held]}))


#: Published examples: mean, covariance, then right ascension, declination, axes, position angle and area at 90 percent.
TILTED = [
    ([1, 0, 0], [[0.1, 0, 0], [0, 0.1, -0.15], [0, -0.15, 1]], (0.0, 0.0, 64.77133127092944, 33.50754131182688, 80.78231196786841, 6372.344658663043)),
    ([1, 0, 0], [[0.1, 0, 0], [0, 0.1, 0.15], [0, 0.15, 1]], (0.0, 0.0, 64.7713312709305, 33.507541311827445, 99.21768803213162, 6372.344658663096)),
    ([1, 0, 0], [[0.1, 0, 0], [0, 1, 0.15], [0, 0.15, 0.1]], (0.0, 0.0, 64.77564486039145, 33.509863018519894, 170.78252287327365, 6372.42573159241)),
]


@pytest.mark.parametrize("mean, cov, want", TILTED)
def test_published_ellipses(spark, mean, cov, want):
    order = 5  # the examples have order 9
    r = contours.find_ellipse(gaussian(spark, mean, np.linalg.inv(cov), order), order, [0.9]).first()
    assert abs((r.ra + 180) % 360 - 180) < 0.05 and abs(r.dec) < 0.05
    assert (r.a, r.b, r.pa, r.area) == pytest.approx(want[2:], rel=5e-3)


def test_multi_order_maps_other_projections_and_levels_out_of_reach(spark):
    order = 5
    m = gaussian(spark, [0, 1, 0], np.linalg.inv(np.diag(np.square(np.radians([6, 6, 12])))), order)
    flat = {r.level: r for r in contours.find_ellipse(m, order, [0.5, 0.9, 1.5]).collect()}
    moc = m.select((F.col("ipix") + 4 ** (order + 1)).alias("uniq"), (F.col("prob") / (math.pi / 3 * 0.25**order)).alias("probdensity"))
    multi = {r.level: r for r in contours.find_ellipse(moc, None, [0.5, 0.9]).collect()}
    assert flat[0.9].ra == pytest.approx(90, abs=0.1) and flat[0.9].pa == pytest.approx(90, abs=0.5)
    assert math.isnan(flat[1.5].a) and math.isnan(flat[1.5].area)
    for level in (0.5, 0.9):
        assert tuple(multi[level]) == pytest.approx(tuple(flat[level]), rel=1e-6)
    a = {p: contours.find_ellipse(m, order, [0.9], projection=p).first().a for p in contours.PROJECTIONS}
    assert a["SIN"] < a["ZEA"] < a["ARC"] < a["STG"] < a["TAN"]
    with pytest.raises(ValueError):
        contours.find_ellipse(m, order, projection="XYZ")


def test_a_cell_clipped_once_stays_out(spark):
    """A far bright cell is clipped; the covariance is then that of the rest in all rounds."""
    order = 4
    npix = 12 * 4**order
    v = healpix.pix2vec(np.full(npix, order), np.arange(npix))
    near = np.arccos(np.clip(v[:, 0], -1, 1)) < np.radians(12)
    p = near.astype(float)
    p[np.argmax(v[:, 1])] = 0.02 * p.sum()
    p /= p.sum()
    held = np.flatnonzero(p)
    m = spark.createDataFrame(pd.DataFrame({"ipix": held, "prob": p[held]}))
    r = contours.find_ellipse(m, order, [0.9]).first()
    assert r.a < 14 and r.b < 14
