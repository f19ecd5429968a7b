"""Series and histograms of result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import beta_quantile
from ..functions.types import vectorized
from .prefix import cumulative_by_range


def pp_series(df: DataFrame, value: str = "p_value", keys: list[str] = []) -> DataFrame:
    """(keys, p, fraction): sorted values against rank / n, with (0, 0) and (1, 1) added.  Ranks are counted by range, whatever the size of a group."""
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("p"))
    ranked = cumulative_by_range(known, keys, [F.asc("p")], {"_k": F.lit(1)})
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))
    inner = ranked.select(*keys, "p", (F.col("_k") / F.col("_n")).alias("fraction"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    ends = groups.select(*keys, F.explode(F.array(F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("fraction")), F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("fraction")))).alias("e")).select(*keys, "e.*")
    return inner.unionByName(ends)


def pp_worst(series: DataFrame, keys: list[str] = []) -> DataFrame:
    """The point farthest from the diagonal."""
    far = F.abs(F.col("fraction") - F.col("p"))
    return series.groupBy(*keys).agg(F.max_by(F.struct("p", "fraction"), F.struct(far, -F.col("p"))).alias("w"), F.max(far).alias("deviation")).select(*keys, "w.p", "w.fraction", "deviation")


def pp_band(df: DataFrame, level: float = 0.95) -> DataFrame:
    """(k, low, high): interval of the k-th of as many sorted uniform values as ``df`` has rows, by the inverse beta function."""
    n = df.count()

    @vectorized("struct<low:double,high:double>")
    def band(k: pd.Series) -> pd.DataFrame:
        a = k.to_numpy(float)
        tail = (1 - level) / 2
        return pd.DataFrame({"low": beta_quantile(tail, a, n + 1 - a), "high": beta_quantile(1 - tail, a, n + 1 - a)})

    return df.sparkSession.range(1, n + 1).select(F.col("id").alias("k"), band("id").alias("b")).select("k", "b.low", "b.high")


def pp_lightning(df: DataFrame, key: str, curves: int, seed: int = 0) -> DataFrame:
    """(curve, p, fraction): sorted uniform draws for comparison, one for each row of ``df`` and curve.

    A draw is a hash of seed, curve and ``key``: the same however the rows lie.
    """
    each = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(curves - 1))).alias("curve"))
    held = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("curve").cast("string"), F.col(key).cast("string")), 256)
    draws = each.select("curve", (F.conv(F.substring(held, 1, 12), 16, 10).cast("long") / float(16**12)).alias("p_value"))
    return pp_series(draws, "p_value", ["curve"])


def thresholds(df: DataFrame, key: str, bounds: list[float] | None = None, largest: bool = True) -> DataFrame:
    """Nested subsets by a key: (bound, row) for every bound that the row passes.

    Bounds are powers of ten below the values unless given; ``largest=False`` keeps values up to the bound.
    """
    if bounds is None:
        low, high = df.where(F.col(key) > 0).agg(F.floor(F.log10(F.min(key))), F.floor(F.log10(F.max(key)))).first()
        if low is None:
            raise ValueError(f"no valid values of {key}")
        bounds = [10.0**k for k in range(low, high + 1)]
    some = F.broadcast(df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(b)) for b in bounds])).alias("bound")))
    return df.crossJoin(some).where(F.col(key) >= F.col("bound") if largest else F.col(key) <= F.col("bound"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, log: bool = True, cumulative: bool = False, normed: bool = False, keys: list[str] = []) -> DataFrame:
    """(keys, bin, left, n or share) over ``bins`` bins of (logarithmic) width; values outside are left out."""
    f = F.log10 if log else (lambda c: c)
    a, b = (math.log10(low), math.log10(high)) if log else (float(low), float(high))
    x = f(F.col(value).cast("double"))
    # the last bin holds its right edge
    k = F.least(F.floor((x - a) / (b - a) * bins), F.lit(bins - 1)).cast("int")
    rows = df.where((F.col(value) >= low) & (F.col(value) <= high)).select(*keys, k.alias("bin"))
    out = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).cast("double").alias("n"))
    edge = F.lit(a) + F.col("bin") * ((b - a) / bins)
    if cumulative:
        out = out.withColumn("n", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")))
    if normed:
        total = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
        out = (out.join(total, keys) if keys else out.crossJoin(F.broadcast(total))).withColumn("n", F.col("n") / F.col("_all")).drop("_all")
    return out.select(*keys, "bin", (F.pow(F.lit(10.0), edge) if log else edge).alias("left"), "n")


def empirical_quantiles(df: DataFrame, value: str, n: int, keys: list[str] = []) -> DataFrame:
    """(keys, share, value) at ``n`` even shares, by running sums over ranges: no group is held."""
    from .moments import weighted_quantile

    shares = [float(x) for x in np.linspace(0, 1, n)]
    rows = df.select(*keys, value, F.lit(1.0).alias("_weight"))
    return weighted_quantile(rows, value, "_weight", shares, keys).select(*keys, F.col("q").alias("share"), value)
