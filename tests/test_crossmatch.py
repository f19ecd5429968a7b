"""Cross-match in two and three dimensions, modes at every density: against plain versions and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import cosmology as C
from skylattice.functions import distance as D
from skylattice.functions import healpix
from skylattice.operators import crossmatch, modes, volumes

LEVELS = [0.25, 0.5, 0.9, 0.999]


def plain_modes(uniq, value):
    """Modes after each cell, cells painted at the highest order."""
    order = np.array([(int(u).bit_length() - 1) // 2 - 1 for u in uniq])
    top, owner = order.max(), {}
    for c, (o, p) in enumerate(zip(order, uniq - 4 ** (order + 1))):
        for q in range(int(p) << (2 * (top - o)), (int(p) + 1) << (2 * (top - o))):
            owner[q] = c
    near = [set() for _ in uniq]
    for q, c in owner.items():
        near[c] |= {owner[n] for n in healpix.neighbours(np.array([top]), np.array([q]))[0].tolist() if n in owner}
    root, seen, out, count = list(range(len(uniq))), set(), {}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for c in np.lexsort((uniq, -value)):
        count += 1
        for n in near[c] & seen:
            if find(n) != find(c):
                root[find(n)] = find(c)
                count -= 1
        seen.add(c)
        out[int(uniq[c])] = count
    return out


def some_map(rng, lost, ties, deepest=4):
    out = []

    def split(order, ipix):
        if order < deepest and rng.random() < 0.75:
            for k in range(4):
                split(order + 1, 4 * ipix + k)
        elif rng.random() >= lost:
            out.append(ipix + 4 ** (order + 1))

    for p in range(12):
        split(0, p)
    uniq = np.array(out, np.int64)
    return uniq, rng.integers(0, 5, len(uniq)).astype(float) if ties else rng.random(len(uniq))


@pytest.mark.parametrize("leaf, step, deepest", [(6, 3, 4), (1, 1, 3)])
def test_modes_at_every_density(spark, leaf, step, deepest):
    rng, rows, want = np.random.default_rng(3), [], {}
    for m, (lost, ties) in enumerate([(0.0, False), (0.3, True), (0.8, False)]):
        uniq, value = some_map(rng, lost, ties, deepest)
        want[m] = plain_modes(uniq, value)
        rows += [(m, int(u), float(v)) for u, v in zip(uniq, value)]
    df = spark.createDataFrame(rows, "m long, uniq long, probdensity double")
    ended = modes.merges(df, ["m"], leaf=leaf, step=step)
    upto = Window.partitionBy("m").orderBy(F.desc("probdensity"), "uniq").rowsBetween(Window.unboundedPreceding, 0)
    got = df.join(ended, ["m", "uniq"], "left").withColumn("n", F.sum(1 - F.coalesce("merged", F.lit(0))).over(upto)).collect()
    assert len(got) == len(rows) and all(r.n == want[r.m][r.uniq] for r in got)


def test_modes_of_nothing_and_of_unknown_densities(spark):
    none = spark.createDataFrame([], "uniq long, probdensity double")
    assert modes.with_steps(none).collect() == []
    m = spark.createDataFrame([(16, 1.0), (17, None), (18, float("nan"))], "uniq long, probdensity double")
    assert sum(r.modes_step for r in modes.with_steps(m).collect()) == 1


def test_a_block_keeps_only_its_border():
    rng = np.random.default_rng(0)
    uniq = np.arange(4**6, dtype=np.int64) + 4**7  # one base pixel of order 6
    import pandas as pd

    rows = pd.DataFrame({"kind": 0, "uniq": uniq, "value": rng.random(len(uniq)), "other": 0, "at": 0.0, "cell": 0})
    border, edges, ended = modes.settle(rows, 6, 0, None)
    assert len(border) == 4 * 64 - 4 and len(edges) < len(border) and len(edges) + ended["n"].sum() == len(uniq) - 1


# --- space


def space_map(rng, order=2, key=0):
    npix = 12 * 4**order
    p = rng.random(npix) ** 3
    mu, sigma, norm = D.moments_to_parameters(100 + 50 * rng.random(npix), 10 + 15 * rng.random(npix))
    rows = [(key, k + 4 ** (order + 1), float(p[k] / p.sum() / (4 * math.pi / npix)), float(mu[k]), float(sigma[k]), float(norm[k])) for k in range(npix)]
    rows[5] = (*rows[5][:3], math.inf, 1.0, 0.0)
    return rows


def plain_space(rows, catalog, n_r=999, cosmology=False):
    """All voxels sorted by density: volumes of LEVELS, and of each target's voxel."""
    uniq, density, mu, sigma, norm = (np.array([r[k] for r in rows]) for k in range(1, 6))
    area = 4 * math.pi / len(rows)
    mean = sum(density[k] * area * float(D.parameters_to_moments(mu[k], sigma[k])[0]) for k in range(len(rows)) if np.isfinite(mu[k]))
    far = max([6 * mean, *[c[3] for c in catalog]])
    d = far / (n_r + 1)
    r = d * np.arange(1, n_r + 1)
    dv = np.broadcast_to((r**2 + d * d / 12) * d * area, (len(rows), n_r)).copy()
    dp = np.exp(-0.5 * ((r - mu[:, None]) / sigma[:, None]) ** 2) * (density * norm / (sigma * math.sqrt(2 * math.pi)))[:, None] * dv
    if cosmology:
        dv *= C.dvc_dvl_for_dl(r)
    rate = dp / dv
    turn = np.argsort(-rate.ravel(), kind="stable")
    p, v = np.cumsum(dp.ravel()[turn]), np.cumsum(dv.ravel()[turn])
    level = np.interp(LEVELS, np.concatenate(([0], p)), np.concatenate(([0], v)), right=np.inf)
    cum_p, cum_v = np.empty(rate.size), np.empty(rate.size)
    cum_p[turn], cum_v[turn] = p, v
    cdf = sum(density[k] * area * D.cdf(r, mu[k], sigma[k], norm[k]) for k in range(len(rows)))
    out = {}
    for i, ra, dec, dist in catalog:
        cell = int(healpix.ang2pix(np.array([2]), np.array([math.pi / 2 - dec]), np.array([ra]))[0])
        shell = min(max(int((r <= dist).sum()), 1), n_r) - 1
        k = cell * n_r + shell
        out[i] = (cum_v[k], cum_p[k], rate[cell, shell], float(np.interp(dist, np.concatenate(([0], r)), np.concatenate(([0], cdf)), right=1)))
    ends = [np.interp(x, np.concatenate(([0], cdf)), np.concatenate(([0], r)), right=np.inf) for x in (0.25, 0.75)]
    return dict(zip(LEVELS, level)), out, ends[1] - ends[0]


CATALOG = [(0, 0.1, 0.2, 120.0), (1, 3.0, -1.0, 80.0), (2, 5.0, 1.2, 0.01), (3, 1.0, 0.0, 2500.0), (4, 2.0, 0.5, 140.0), (5, 2.0, 0.5, 140.0)]


@pytest.mark.parametrize("cosmology", [False, True])
def test_volumes_are_those_of_the_sort(spark, cosmology):
    rng = np.random.default_rng(4)
    maps = {k: space_map(rng, key=k) for k in range(2)}
    df = spark.createDataFrame([r for m in maps.values() for r in m], "m long, uniq long, probdensity double, distmu double, distsigma double, distnorm double").repartition(5)
    catalog = crossmatch.catalog_points(spark.createDataFrame(CATALOG, "id long, ra double, dec double, distance double"))
    got = crossmatch.crossmatch(df, catalog, LEVELS, [], keys=["m"], cosmology=cosmology).collect()
    assert len(got) == 2 * len(CATALOG)
    width = {r.m: r.contour_dists[1] for r in got}
    for m, rows in maps.items():
        level, targets, middle = plain_space(rows, CATALOG, cosmology=cosmology)
        assert width[m] == pytest.approx(middle, rel=1e-6)
        for r in (r for r in got if r.m == m):
            assert r.contour_vols == pytest.approx(list(level.values()), rel=1e-6)
            want = targets[r.id]
            assert (r.searched_prob_vol, r.probdensity_vol, r.searched_prob_dist) == pytest.approx(want[1:], rel=1e-6, abs=1e-12)
            if want[2] > 0:  # voxels without any density left are in no order
                assert r.searched_vol == pytest.approx(want[0], rel=1e-6)


def test_thresholds_in_several_passes(spark):
    df = spark.createDataFrame(space_map(np.random.default_rng(5)), "m long, uniq long, probdensity double, distmu double, distsigma double, distnorm double").drop("m")
    cells = volumes.cells_of(df, spark.createDataFrame([(900.0,)], "max_r double"), [], 99)
    wanted = spark.range(40).select((F.lit(-10.0) - F.col("id") / 3).alias("rate"))
    held = [{r.rate: (r.cum_p, r.cum_v) for r in volumes.sums_above(cells, wanted, [], 99, most=most).collect()} for most in (7, 1000)]
    # a threshold that no voxel separates from the next one has no row of its own
    assert held[0].keys() >= held[1].keys() and all(held[0][k] == pytest.approx(v) for k, v in held[1].items())


def test_no_row_for_a_voxel_is_shuffled(spark):
    df = spark.createDataFrame(space_map(np.random.default_rng(6)), "m long, uniq long, probdensity double, distmu double, distsigma double, distnorm double").drop("m")
    cells = volumes.cells_of(df, spark.createDataFrame([(900.0,)], "max_r double"), [], 999)
    rows = volumes.sums_between(cells.repartition(3), [(-20.0,), (-15.0,)], [], 999, False)
    assert rows.count() <= 2  # 192 * 999 voxels


def test_a_gaussian_in_space_has_its_closed_form(spark):
    """An isotropic normal distribution about a point away from the origin: volumes and densities by the chi distribution."""
    order, centre, width = 5, np.array([3.0, 1.0, -1.0]), 0.6
    npix = 12 * 4**order
    n = healpix.pix2vec(np.full(npix, order), np.arange(npix))
    along, apart = n @ centre, centre @ centre - (n @ centre) ** 2
    s2 = width**2
    norm_ = np.exp(-0.5 * apart / s2) / (2 * math.pi * s2)
    mu, sigma = along, np.full(npix, width)
    r = np.linspace(0, 12, 24001)
    whole = np.array([np.trapezoid(r * r * np.exp(-0.5 * ((r - a) / width) ** 2), r) / (width * math.sqrt(2 * math.pi)) for a in along])
    rows = [(k + 4 ** (order + 1), float(norm_[k] * whole[k]), float(mu[k]), float(sigma[k]), float(1 / whole[k])) for k in range(npix)]
    df = spark.createDataFrame(rows, "uniq long, probdensity double, distmu double, distsigma double, distnorm double")
    xyz = centre + width * np.array([[0.3, 0.2, -0.1], [1.0, -0.5, 0.7], [-0.2, -1.4, 0.4]])
    far = np.sqrt((xyz**2).sum(axis=1))
    targets = [(k, float(math.atan2(p[1], p[0]) % (2 * math.pi)), float(math.asin(p[2] / q)), float(q)) for k, (p, q) in enumerate(zip(xyz, far))]
    got = crossmatch.crossmatch(df, crossmatch.catalog_points(spark.createDataFrame(targets, "id long, ra double, dec double, distance double")), [0.5, 0.9], []).collect()
    unit, chi = 4 / 3 * math.pi * width**3, lambda x: math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) * x * math.exp(-x * x / 2)
    median, ninety = 1.5381722544550522, 2.5002777108094
    for r in got:
        assert r.contour_vols == pytest.approx([unit * median**3, unit * ninety**3], rel=5e-3)
        q = float(np.sqrt(((xyz[r.id] - centre) ** 2).sum()) / width)
        assert r.searched_prob_vol == pytest.approx(chi(q), abs=6e-2)  # a cell is a sixth of the width
        assert r.probdensity_vol == pytest.approx(math.exp(-q * q / 2) / (2 * math.pi * s2) ** 1.5, rel=0.15)


def test_levels_that_a_map_does_not_reach(spark):
    m = spark.createDataFrame([(16, 0.1)], "uniq long, probdensity double")
    catalog = crossmatch.catalog_points(spark.createDataFrame([(0, 0.8, 0.3)], "id long, ra double, dec double"))
    a = crossmatch.crossmatch(m, catalog, [0.01, 0.9], [100.0, 50_000.0], modes=True).collect()
    whole = 4 * 180**2 / math.pi
    for r in a:
        assert r.contour_areas[1] == pytest.approx(whole) and r.contour_areas[0] < 1000 and r.area_probs[1] == 1.0
        assert r.searched_vol is None and r.contour_vols is None and r.searched_prob_dist is None
