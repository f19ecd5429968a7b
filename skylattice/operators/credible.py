"""Greedy credible levels, regions, and what is read off the curve of their prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import index as ix
from .prefix import cumulative, cumulative_by_range

DEG2 = (180 / math.pi) ** 2
WHOLE_SKY = 4 * math.pi * DEG2  # square degrees


def greedy_levels(df: DataFrame, weight: str, keys: list[str] = [], ranking: Column | None = None, tie: str = "uniq", by_range: bool | None = None) -> DataFrame:
    """Add ``cls``: the share of ``weight`` in cells ranked at or before each, densest first; ties by ``tie``.

    ``by_range`` uses the two-phase sums, so that no map is held in one task; ``False`` sorts each map in a task of its own, for many small ones.
    """
    by_range = True if by_range is None else by_range
    order = [(F.col(weight) if ranking is None else ranking).desc(), F.col(tie).asc()]
    run = cumulative_by_range if by_range else cumulative
    out = run(df, keys, order, {"_upto": F.col(weight)})
    total = Window.partitionBy(*keys) if keys else None
    if total is not None and not by_range:
        return out.withColumn("cls", F.col("_upto") / F.sum(weight).over(total)).drop("_upto")
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_all"))
    out = out.join(sums, keys) if keys else out.crossJoin(F.broadcast(sums))
    return out.withColumn("cls", F.col("_upto") / F.col("_all")).drop("_upto", "_all")


def curve(df: DataFrame, weight: str, density: Column, area: Column, keys: list[str] = [], by_range: bool | None = None) -> DataFrame:
    """Running probability and area (square degrees) in greedy order: columns cum_weight, cum_area, and those before.

    ``by_range``: as for the levels, two-phase sums instead of one sort in a task for each map.
    """
    by_range = True if by_range is None else by_range
    order = [density.desc(), F.col("uniq").asc()]
    m = df.withColumn("_own_area", area)
    out = (cumulative_by_range if by_range else cumulative)(m, keys, order, {"cum_weight": F.col(weight), "cum_area": F.col("_own_area")})
    if by_range:
        before = [F.col("cum_weight") - F.col(weight), F.col("cum_area") - F.col("_own_area")]
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        before = [F.coalesce(F.lag("cum_weight").over(w), F.lit(0)), F.coalesce(F.lag("cum_area").over(w), F.lit(0.0))]
    return out.withColumn("prev_weight", before[0]).withColumn("prev_area", before[1]).drop("_own_area")


def interpolate(curve_df: DataFrame, levels: DataFrame, x: str, y: str, prev_x: str, prev_y: str, level: str, keys: list[str] = [], right: Column | None = None) -> DataFrame:
    """Value of ``y`` where ``x`` reaches each level, linear between points, from (0, 0).

    ``levels`` (keys, level) is small; the segment that holds a level is found by a broadcast range join.
    Beyond the end of the curve the value is ``right``, by default the last one.
    """
    ends = curve_df.groupBy(*keys).agg(F.max(x).alias("_x"), F.max_by(y, x).alias("_y"))
    asked = F.broadcast(levels)
    hit = (F.col(prev_x) < F.col(level)) & (F.col(level) <= F.col(x))
    own = [c for c in levels.columns if c != level]
    on = hit
    renamed = asked
    for c in own:
        renamed = renamed.withColumnRenamed(c, f"_l_{c}")
        on = on & (F.col(c) == F.col(f"_l_{c}"))
    line = F.col(prev_y) + (F.col(level) - F.col(prev_x)) * (F.col(y) - F.col(prev_y)) / (F.col(x) - F.col(prev_x))
    found = curve_df.join(renamed, on).select(*keys, level, line.alias(y))
    all_ = ends.join(asked, own) if own else ends.crossJoin(asked)
    beyond = F.col("_y") if right is None else right
    out = all_.join(found, [*keys, level], "left")
    return out.select(*keys, level, F.when(F.col(level) > F.col("_x"), beyond).when(F.col(level) <= 0, F.lit(0.0)).otherwise(F.col(y)).alias(y))


def region(df: DataFrame, weight: str, level: float, keys: list[str] = [], ranking: Column | None = None, by_range: bool | None = None) -> DataFrame:
    """Cells of the smallest region that holds ``level`` of the weight, the cell that reaches it included."""
    by_range = True if by_range is None else by_range
    out = greedy_levels(df, weight, keys, ranking, by_range=by_range)
    if by_range:
        sums = df.groupBy(*keys).agg(F.sum(weight).alias("_all"))
        out = out.join(sums, keys) if keys else out.crossJoin(F.broadcast(sums))
        return out.where(F.col("cls") - F.col(weight) / F.col("_all") < level - 1e-15).drop("_all")
    order = [(F.col(weight) if ranking is None else ranking).desc(), F.col("uniq").asc()]
    before = F.coalesce(F.lag("cls").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))
    return out.withColumn("_before", before).where(F.col("_before") < level).drop("_before")


def areas(df: DataFrame, levels: list[float], keys: list[str] = [], density: str = "probdensity", right: float | None = None) -> DataFrame:
    """(keys, level, area): area in square degrees of the credible region of each level, interpolated; ``right`` where a map doesn't reach it."""
    spark = df.sparkSession
    m = df.withColumn("_area", ix.uniq2pixarea("uniq") * DEG2).withColumn("_prob", F.col(density) * ix.uniq2pixarea("uniq"))
    c = curve(m, "_prob", F.col(density), F.col("_area"), keys)
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    return interpolate(c, wanted, "cum_weight", "cum_area", "prev_weight", "prev_area", "level", keys, None if right is None else F.lit(right)).withColumnRenamed("cum_area", "area")


def exclude_not_finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all finite, the filter before every sum over distances."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & ix.isfinite(c)
    return df.where(keep)
