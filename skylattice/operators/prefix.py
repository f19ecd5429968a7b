"""Ordered prefix sums, by window or, for one very large map, by ranges in two phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import spill


def cumulative(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums within ``keys`` in the total order ``order``.  All sums share one sort."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(value).over(w).alias(name) for name, value in sums.items()])


def cumulative_by_range(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """The same for groups too large for one task.

    Rows are dealt by range, each range sums its own rows, and the totals of the ranges
    before it (as many rows as there are ranges) are added.
    """
    by = [F.col(k) for k in keys] + order
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    dealt = spill(dealt.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.select("*", *[F.sum(value).over(inside).alias(name) for name, value in sums.items()])
    totals = dealt.groupBy("_range", *keys).agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *keys, *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    out = out.join(starts, ["_range", *keys])
    kept = [c for c in df.columns]
    return out.select(*kept, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])
