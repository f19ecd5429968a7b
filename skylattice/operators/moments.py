"""Aggregates of maps: marginal distances, directions, axes, groups, quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import index as ix
from ..functions.types import fields
from ..storage import spill


def marginal_moments(df: DataFrame, keys: list[str] = [], prob: str = "prob") -> DataFrame:
    """(distmean, diststd) of the whole map, from the moments of its pixels with finite distance."""
    m = df.withColumn("_m", D.to_moments("distmu", "distsigma")).select(*keys, F.col(prob).alias("_p"), "_m.*")
    return marginal_of_moments(m.withColumnRenamed("_p", prob), keys, prob)


def marginal_of_moments(df: DataFrame, keys: list[str] = [], prob: str = "prob") -> DataFrame:
    """The same from columns distmean and diststd, as plain aggregates."""
    good = df.where(ix.isfinite(prob) & ix.isfinite("distmean") & ix.isfinite("diststd"))
    s1, s2 = F.sum(F.col(prob) * F.col("distmean")), F.sum(F.col(prob) * (F.col("diststd") * F.col("diststd") + F.col("distmean") * F.col("distmean")))
    return good.groupBy(*keys).agg(s1.alias("distmean"), s2.alias("_s2")).select(*keys, "distmean", F.sqrt(F.col("_s2") - F.col("distmean") * F.col("distmean")).alias("diststd"))


def _marginal(df: DataFrame, radii: list[float], keys: list[str], kernel, name: str) -> DataFrame:
    """Sum over pixels of prob * kernel(r), for a grid of radii: vector sums per Arrow batch, then per map."""
    grid = np.asarray(radii, float)
    plain = df.select(*keys, *[F.col(c).cast("double") for c in ("prob", "distmu", "distsigma", "distnorm")])
    out = "".join(f"{k}:{_type(df, k)}," for k in keys) + "k:int,v:double"

    def partial(batches):
        for b in batches:
            for key, rows in b.groupby(keys, dropna=False) if keys else [((), b)]:
                p, mu, sigma, norm = (rows[c].to_numpy(float)[:, None] for c in ("prob", "distmu", "distsigma", "distnorm"))
                v = np.zeros(len(grid))
                for i in range(0, len(rows), 2048):
                    s = slice(i, i + 2048)
                    v += (p[s] * kernel(grid[None, :], mu[s], sigma[s], norm[s])).sum(axis=0)
                yield pd.DataFrame({**dict(zip(keys, key)), "k": np.arange(len(grid)), "v": v})

    sums = plain.mapInPandas(partial, fields(out)).groupBy(*keys, "k").agg(F.sum("v").alias(name))
    radius = F.array(*[F.lit(float(r)) for r in grid])
    return sums.select(*keys, F.element_at(radius, F.col("k") + 1).alias("r"), name)


def _type(df: DataFrame, column: str) -> str:
    return {"bigint": "long"}.get(dict(df.dtypes)[column], dict(df.dtypes)[column])


def marginal_pdf(df: DataFrame, radii: list[float], keys: list[str] = []) -> DataFrame:
    return _marginal(df, radii, keys, D.pdf, "pdf")


def marginal_cdf(df: DataFrame, radii: list[float], keys: list[str] = []) -> DataFrame:
    return _marginal(df, radii, keys, D.cdf, "cdf")


def marginal_ppf(df: DataFrame, p: float, keys: list[str] = [], steps: int = 6) -> DataFrame:
    """(keys, distance) at which the marginal distribution reaches ``p``."""
    return marginal_quantiles(df, [p], keys, steps).drop("k", "p")


def marginal_quantiles(df: DataFrame, shares: list[float], keys: list[str] = [], steps: int = 6, cuts: int = 128) -> DataFrame:
    """(keys, k, p, distance): where the marginal distribution of each map reaches each share.

    Each step is one job for all maps and shares: every map's bracket of each share is cut in ``cuts`` parts, the
    distribution is summed at the cuts by partial sums of Arrow batches, and the part that holds the share is the next bracket.
    No map is gathered; ``steps`` of 128 parts are 2^-42 of the first bracket.  0 for shares up to 0, NaN without finite distances.
    """
    names = ("prob", "distmu", "distsigma", "distnorm")
    plain = df.select(*keys, *[F.col(c).cast("double") for c in names])
    good = plain.where(ix.isfinite("distmu") & ix.isfinite("distsigma"))
    reach = good.groupBy(*keys).agg(F.max(F.greatest(F.col("distmu"), F.lit(0.0)) + 10 * F.col("distsigma")).alias("_top"))
    n = len(shares)
    both = lambda value: F.array(*[value] * n)
    state = reach.select(*keys, both(F.lit(0.0)).alias("low"), both(F.col("_top")).alias("high"))
    out = "".join(f"{k}:{_type(df, k)}," for k in keys) + "k:int,i:int,v:double"
    at = np.arange(1, cuts) / cuts
    own = [k for k in keys]

    def partial(batches):
        for b in batches:
            for key, rows in b.groupby(own, dropna=False) if own else [((), b)]:
                low, high = np.asarray(rows["low"].iloc[0], float), np.asarray(rows["high"].iloc[0], float)
                grid = (low[:, None] + (high - low)[:, None] * at).ravel()
                q = [rows[c].to_numpy(float)[:, None] for c in names]
                v = np.zeros(len(grid))
                for i in range(0, len(rows), 1024):
                    part = [x[i : i + 1024] for x in q]
                    v += (part[0] * D.cdf(grid[None, :], *part[1:])).sum(axis=0)
                yield pd.DataFrame({**dict(zip(own, key)), "k": np.repeat(np.arange(n), cuts - 1), "i": np.tile(np.arange(1, cuts), n), "v": v})

    wanted = F.array(*[F.lit(float(p)) for p in shares])
    for _ in range(steps):
        joined = good.join(state, keys) if keys else good.crossJoin(F.broadcast(state))
        sums = joined.mapInPandas(partial, fields(out)).groupBy(*keys, "k", "i").agg(F.sum("v").alias("v"))
        below = sums.groupBy(*keys, "k").agg(F.max(F.when(F.col("v") < F.element_at(wanted, F.col("k") + 1), F.col("i")).otherwise(0)).alias("i"))
        cell = below.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "i"))).alias("c"))
        placed = state.join(cell, keys) if keys else state.crossJoin(F.broadcast(cell))
        edge = lambda add: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get("low", k) + (F.get("high", k) - F.get("low", k)) * (F.get(F.col("c"), k)["i"] + add) / cuts)
        state = spill(placed.select(*keys, edge(0).alias("low"), edge(1).alias("high")))
    maps = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    found = maps.join(state, keys, "left") if keys else maps.join(state, F.lit(True), "left")
    rows = found.select(*keys, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    middle = F.coalesce((F.get("low", F.col("k")) + F.get("high", F.col("k"))) / 2, F.lit(float("nan")))
    return rows.select(*keys, "k", F.element_at(wanted, F.col("k") + 1).alias("p"), F.when(F.element_at(wanted, F.col("k") + 1) <= 0, 0.0).otherwise(middle).alias("distance"))


def _vectors(df: DataFrame) -> DataFrame:
    order, ipix = ix.uniq2nest("uniq")
    return df.withColumn("_v", ix.nest2vec(order, ipix))


def direction(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(theta, phi) of a vector."""
    return F.atan2(F.sqrt(x * x + y * y), z), F.pmod(F.atan2(y, x), F.lit(2 * np.pi))


def posterior_mean(df: DataFrame, keys: list[str] = [], prob: str = "prob") -> DataFrame:
    """Direction of the mean unit vector of a map with ``uniq`` and ``prob``."""
    sums = _vectors(df).groupBy(*keys).agg(*[F.sum(F.col(prob) * F.col(f"_v.{c}")).alias(c) for c in "xyz"])
    theta, phi = direction(F.col("x"), F.col("y"), F.col("z"))
    return sums.select(*keys, theta.alias("theta"), phi.alias("phi"))


def posterior_max(df: DataFrame, keys: list[str] = [], prob: str = "prob") -> DataFrame:
    """(uniq, theta, phi) of the most probable cell; the smaller uniq of equal ones."""
    top = df.groupBy(*keys).agg(F.max_by("uniq", F.struct(F.col(prob), -F.col("uniq"))).alias("uniq"))
    return top.withColumn("_a", ix.uniq2ang("uniq")).select(*keys, "uniq", "_a.theta", "_a.phi")


def principal_axes(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, axes array<array<double>>): right-handed eigenvectors of the mass-weighted second moments.

    The mass of a cell is its probability times the distance moment mean^2 + std^2; cells
    without finite distance are left out.
    """
    m = _vectors(df.withColumn("_m", D.to_moments("distmu", "distsigma")))
    m = m.where(ix.isfinite("prob") & ix.isfinite("distmu") & ix.isfinite("distsigma"))
    mass = F.col("prob") * (F.col("_m.diststd") ** 2 + F.col("_m.distmean") ** 2)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = m.groupBy(*keys).agg(*[F.sum(mass * F.col(f"_v.{a}") * F.col(f"_v.{b}")).alias(a + b) for a, b in pairs])

    def axes(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                _, e = np.linalg.eigh(np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]]))
                if np.linalg.det(e) < 0:
                    e[:, 0] = -e[:, 0]
                out.append(e.tolist())
            yield b[keys].assign(axes=out)

    return sums.mapInPandas(axes, fields("".join(f"{k}:{_type(df, k)}," for k in keys) + "axes:array<array<double>>"))


def by_region(df: DataFrame, regions: DataFrame, keys: list[str] = [], prob: str = "prob", name: str = "region") -> DataFrame:
    """Probability by region of the sky, largest first.

    ``regions`` is a user's table (uniq, region) of cells that cover the sky, such as constellations.
    Each cell of the map belongs to the region that holds its centre.
    """
    from .crossmatch import locate

    # the centre is the corner at which its four children meet; the last of them holds it
    order, ipix = ix.uniq2nest("uniq")
    centre = ix.first_descendant(ipix, F.lit(29) - order) + F.when(order < 29, 3 * ix.first_descendant(F.lit(1), F.lit(28) - order)).otherwise(0)
    points = df.withColumn("p29", centre)
    found = locate(points.select(*keys, "p29", prob), regions, [])
    return found.groupBy(*keys, name).agg(F.sum(prob).alias(prob)).orderBy(*keys, F.desc(prob), name)


def weighted_quantile(df: DataFrame, value: str, weight: str, q: list[float], keys: list[str] = [], interpolation: str = "linear") -> DataFrame:
    """(keys, q, value): quantiles of weighted rows in prefix sums, without gathering a group.

    The k-th sorted row stands at (sum of weights before it) / (total - last weight); null and NaN
    values or weights are left out.  ``interpolation``: linear, lower, higher, nearest or midpoint.
    """
    from .prefix import cumulative_by_range

    rows = df.where(ix.isfinite(weight) & (F.col(weight) > 0) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    rows = cumulative_by_range(rows, keys, [F.asc("v"), F.asc("w")], {"_upto": F.col("w")}).withColumn("_before", F.col("_upto") - F.col("w"))
    last = rows.groupBy(*keys).agg(F.max("_before").alias("_span"))
    rows = rows.join(last, keys) if keys else rows.crossJoin(F.broadcast(last))
    at = F.when(F.col("_span") > 0, F.col("_before") / F.col("_span")).otherwise(0.0)
    point = F.struct(at.alias("at"), F.col("v"))
    ends = [f(F.when(on, point)).alias(f"{n}{k}") for k, x in enumerate(q) for n, f, on in (("l", F.max, at <= float(x)), ("u", F.min, at > float(x)))]
    found = rows.groupBy(*keys).agg(*ends)

    def rule(k: int, x: float) -> Column:
        low, high = F.col(f"l{k}"), F.col(f"u{k}")
        part = F.coalesce((F.lit(float(x)) - low["at"]) / (high["at"] - low["at"]), F.lit(0.0))
        v, nxt = low["v"], F.coalesce(high["v"], low["v"])
        rules = {
            "linear": v + part * (nxt - v),
            "lower": v,
            "higher": F.when(part > 0, nxt).otherwise(v),
            "nearest": F.when(part > 0.5, nxt).otherwise(v),
            "midpoint": F.when(part > 0, (v + nxt) / 2).otherwise(v),
        }
        return rules[interpolation]

    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("q"), rule(k, x).alias(value)) for k, x in enumerate(q)]))
    return found.where(F.col("l0").isNotNull() | F.col("u0").isNotNull()).select(*keys, each.alias("_e")).select(*keys, "_e.q", f"_e.{value}")


def log_sum_exp(df: DataFrame, value: str, keys: list[str] = [], log_weight: str | None = None) -> DataFrame:
    """log(sum(exp(value + log_weight))) in two aggregates, the largest term taken out."""
    x = F.col(value) if log_weight is None else F.col(value) + F.col(log_weight)
    rows = df.select(*keys, x.alias("_x"))
    top = rows.groupBy(*keys).agg(F.max("_x").alias("_top"))
    both = rows.join(top, keys) if keys else rows.crossJoin(F.broadcast(top))
    return both.groupBy(*keys, "_top").agg(F.sum(F.exp(F.col("_x") - F.col("_top"))).alias("_s")).select(*keys, (F.log("_s") + F.col("_top")).alias("logsumexp"))
