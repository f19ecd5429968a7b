"""Event-time windows over trigger streams (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigger_rate(triggers: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count and mean value by window and key; rows later than the watermark are dropped. Batch or stream."""
    return triggers.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
