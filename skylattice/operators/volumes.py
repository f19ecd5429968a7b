"""Credible volumes without a row for each voxel: thresholds of dP/dV instead of a sort.

A voxel is a cell within a shell of distance.  How many voxels lie above a threshold, and what probability and volume they hold, are
sums: every task makes the shells of its cells in arrays and adds them up between the thresholds; a row for each threshold
leaves it.  The level of a target is the sum above its own voxel's density.  The density at which a level is
reached is found by histograms: each round sums between 1,024 thresholds, and the interval that holds the level is the next range.

Densities are compared as ln(dP/dV) = ln(A) - z^2 / 2, in the same plain arithmetic everywhere, so that a voxel equals itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cosmology as C
from ..functions import index as ix
from ..functions.types import fields
from ..storage import spill
from .prefix import cumulative_by_range

#: Thresholds that a pass over the cells carries (8 bytes each); more of them take more passes.
MOST_THRESHOLDS = 1 << 20
CELL = ("_area", "_log", "distmu", "distsigma", "_step")


def ln_ratio(step: float, n_r: int) -> np.ndarray:
    """ln of comoving volume over volume in luminosity distance, at every shell."""
    return np.log(C.dvc_dvl_for_dl(step * np.arange(1, n_r + 1)))


def cells_of(df: DataFrame, reach: DataFrame, keys: list[str], n_r: int) -> DataFrame:
    """(keys, uniq, area, ln of the density's factor, distmu, distsigma, step of the shells); ``reach`` has (keys, max_r)."""
    m = df.join(reach, keys) if keys else df.crossJoin(F.broadcast(reach))
    factor = F.col("probdensity") * F.col("distnorm") / (F.col("distsigma") * math.sqrt(2 * math.pi))
    log = F.when(ix.isfinite("distmu") & ix.isfinite(factor) & (factor > 0), F.log(factor)).otherwise(F.lit(float("-inf")))
    mu = F.when(ix.isfinite("distmu"), F.col("distmu").cast("double")).otherwise(0.0)
    sigma = F.when(F.col("distsigma") > 0, F.col("distsigma").cast("double")).otherwise(1.0)
    return m.select(*keys, "uniq", ix.uniq2pixarea("uniq").alias("_area"), log.alias("_log"), mu.alias("distmu"), sigma.alias("distsigma"), (F.col("max_r") / (n_r + 1)).alias("_step"))


def shell_of(distance: Column, step: Column, n_r: int) -> Column:
    """The shell at or below a distance, from 1; nearer than the first counts as the first."""
    k = F.floor(distance / step)
    k = k + F.when(step * (k + 1) <= distance, 1).when(step * k > distance, -1).otherwise(0)
    return F.least(F.lit(n_r), F.greatest(F.lit(1), k)).cast("int")


def _shells(rows: pd.DataFrame, n_r: int, cosmology: bool):
    """Yield (ln density, probability, volume) of blocks of cells by all shells, for rows of one map."""
    area, log, mu, sigma, step = (rows[c].to_numpy(float) for c in CELL)
    d = float(step[0])
    r = d * np.arange(1, n_r + 1)
    shell = (r * r + d * d / 12) * d
    ratio = ln_ratio(d, n_r) if cosmology else None
    for i in range(0, len(rows), 512):
        s = slice(i, i + 512)
        z = (r[None, :] - mu[s, None]) / sigma[s, None]
        rate = log[s, None] - 0.5 * z * z
        dv = shell[None, :] * area[s, None]
        dp = np.exp(rate) * dv
        if cosmology:
            yield rate - ratio, dp, dv * np.exp(ratio)
        else:
            yield rate, dp, dv


def sums_between(cells: DataFrame, asked: list, keys: list[str], n_r: int, cosmology: bool) -> DataFrame:
    """(keys, rate, p, v): probability and volume of the voxels from each threshold up to the next.  ``asked`` has a tuple of keys and the threshold."""
    kinds = {k: {"bigint": "long"}.get(t, t) for k, t in cells.dtypes}
    out = "".join(f"{k}:{kinds[k]}," for k in keys) + "rate:double,p:double,v:double"
    limits: dict = {}
    for row in asked:
        limits.setdefault(tuple(row[:-1]), []).append(row[-1])
    limits = {k: np.unique(v) for k, v in limits.items()}

    def partial(batches):
        totals: dict = {}
        for b in batches:
            for key, rows in b.groupby(keys, dropna=False) if keys else [((), b)]:
                at = limits.get(tuple(key))
                if at is None:
                    continue
                if key not in totals:
                    totals[key] = np.zeros((2, len(at) + 1))
                for rate, dp, dv in _shells(rows, n_r, cosmology):
                    some = rate >= at[0]
                    k = np.searchsorted(at, rate[some], "right")
                    totals[key][0] += np.bincount(k, dp[some], len(at) + 1)
                    totals[key][1] += np.bincount(k, dv[some], len(at) + 1)
        for key, (p, v) in totals.items():
            at, full = limits[tuple(key)], np.flatnonzero(v[1:])
            yield pd.DataFrame({**{c: [x] * len(full) for c, x in zip(keys, key)}, "rate": at[full], "p": p[full + 1], "v": v[full + 1]})

    return cells.mapInPandas(partial, fields(out)).groupBy(*keys, "rate").agg(F.sum("p").alias("p"), F.sum("v").alias("v"))


def sums_above(cells: DataFrame, wanted: DataFrame, keys: list[str], n_r: int, cosmology: bool = False, most: int = MOST_THRESHOLDS) -> DataFrame:
    """(keys, rate, cum_p, cum_v) for every (keys, rate) of ``wanted``: probability and volume of all voxels at least as dense."""
    asked = spill(wanted.select(*keys, "rate").distinct())
    passes = max(1, -(-asked.count() // most))
    if passes > 1:
        asked = spill(asked.repartitionByRange(passes, "rate").withColumn("_pass", F.spark_partition_id()))
    out = None
    for k in range(passes):
        some = asked.where(F.col("_pass") == k).drop("_pass") if passes > 1 else asked
        rows = [tuple(r) for r in some.collect()]  # ``most`` or about that many, whatever the catalog
        if not rows and out is not None:
            continue
        between = sums_between(cells, rows, keys, n_r, cosmology)
        above = cumulative_by_range(between, keys, [F.desc("rate")], {"cum_p": F.col("p"), "cum_v": F.col("v")})
        above = above.select(*keys, "rate", "cum_p", "cum_v")
        out = above if out is None else out.unionByName(above)
    return out


def volumes_at(cells: DataFrame, levels: list[float], keys: list[str], n_r: int, cosmology: bool = False, rounds: int = 4, cuts: int = 1024) -> DataFrame:
    """(keys, level, volume): the smallest volume that holds each level, linear within its last voxel; infinite where a map holds less.

    ``rounds`` of ``cuts`` intervals tell apart densities whose logarithms differ by 1e-9 (all of 850, below which nothing is left to add up).
    Each round is one pass over the cells, for all maps and levels.
    """
    n = len(levels)
    kinds = {k: {"bigint": "long"}.get(t, t) for k, t in cells.dtypes}
    own = "".join(f"{k}:{kinds[k]}," for k in keys)
    both = lambda value: F.array(*[value] * n)
    top = cells.groupBy(*keys).agg(F.max("_log").alias("_top"))
    top = top.withColumn("_top", F.when(ix.isfinite("_top"), F.col("_top")).otherwise(0.0))
    state = top.select(*keys, both(F.col("_top") - 800).alias("low"), both(F.col("_top") + 50).alias("high"), both(F.lit(float("inf"))).alias("volume"))

    def partial(batches):
        for b in batches:
            for key, rows in b.groupby(keys, dropna=False) if keys else [((), b)]:
                edges = [_edges(*x, cuts) for x in zip(rows["low"].iloc[0], rows["high"].iloc[0])]
                p, v = np.zeros((n, cuts + 1)), np.zeros((n, cuts + 1))
                for rate, dp, dv in _shells(rows, n_r, cosmology):
                    for j, at in enumerate(edges):
                        some = rate >= at[0]
                        k = np.searchsorted(at, rate[some], "right") - 1
                        p[j] += np.bincount(k, dp[some], cuts + 1)
                        v[j] += np.bincount(k, dv[some], cuts + 1)
                j, k = np.nonzero(v)
                yield pd.DataFrame({**{c: [x] * len(j) for c, x in zip(keys, key)}, "level": j, "cut": k, "p": p[j, k], "v": v[j, k]})

    def narrow(rows: pd.DataFrame) -> pd.DataFrame:
        """The interval of each level that holds it, and the volume if the level is reached there by equal steps of both."""
        low, high, volume = (list(rows[c].iloc[0]) for c in ("low", "high", "volume"))
        for j, level in enumerate(levels):
            mine = rows[(rows["level"] == j)].sort_values("cut", ascending=False)
            p, v, k = (mine[c].to_numpy() for c in ("p", "v", "cut"))
            upto = np.cumsum(p)
            at = int(np.searchsorted(upto, level, "left"))
            if level <= 0:
                volume[j] = 0.0
            elif at < len(upto):
                volume[j] = float(v[:at].sum() + (level - upto[at] + p[at]) / p[at] * v[at])
                edges = _edges(low[j], high[j], cuts)
                if k[at] < cuts:
                    low[j], high[j] = float(edges[k[at]]), float(edges[k[at] + 1])
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in keys}, "low": low, "high": high, "volume": volume}])

    for _ in range(rounds):
        joined = cells.join(state, keys) if keys else cells.crossJoin(F.broadcast(state))
        sums = joined.drop("volume").mapInPandas(partial, fields(own + "level:int,cut:int,p:double,v:double")).groupBy(*keys, "level", "cut").agg(F.sum("p").alias("p"), F.sum("v").alias("v"))
        # a row for each level and interval of a map, a few thousand; those without voxels keep their state
        told = state.join(sums, keys, "left") if keys else state.join(sums, F.lit(True), "left")
        state = spill(told.groupBy(*keys).applyInPandas(narrow, fields(own + "low:array<double>,high:array<double>,volume:array<double>")))
    wanted = F.array(*[F.lit(float(x)) for x in levels])
    return state.select(*keys, F.explode(F.arrays_zip(wanted.alias("level"), F.col("volume").alias("volume"))).alias("x")).select(*keys, "x.level", "x.volume")


def _edges(low: float, high: float, cuts: int) -> np.ndarray:
    """Rising thresholds from ``low`` to ``high``, both included exactly."""
    at = low + (high - low) * (np.arange(cuts + 1) / cuts)
    at[-1] = high
    return np.maximum.accumulate(at)
