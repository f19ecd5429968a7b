"""Maps, catalogs and events derived from the driver's relational tables.

Weights are integers (cents), so that sums agree to the last digit in any order.
``SQL`` has the same derivations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 12 * 4^29, the pixels of order 29.
PIXELS_29 = 12 * 4**29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, ipix, w) at order 2, four maps, every pixel there."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 4).alias("map_id"), (F.col("o_orderkey") % 192).alias("ipix")).agg(F.sum(cents("o_totalprice")).alias("w"))
    grid = spark.range(4).select(F.col("id").alias("map_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(191).cast("long"))).alias("ipix"))
    return grid.join(o, ["map_id", "ipix"], "left").select("map_id", "ipix", (F.coalesce("w", F.lit(0)) + 1).alias("w"))


def sky_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, uniq, w): the flat map with every fourth cell split into unequal children at order 3."""
    flat = flat_map(spark, sf_dir)
    split = flat.where("ipix % 4 = 0").select("map_id", "ipix", "w", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    split = split.select("map_id", (4 * F.col("ipix") + F.col("c") + 256).alias("uniq"), F.floor(F.col("w") * (F.col("c") + 1) / 10).alias("w"))
    return flat.where("ipix % 4 <> 0").select("map_id", (F.col("ipix") + 64).alias("uniq"), "w").unionByName(split)


def line_pixels() -> Column:
    """Pseudo-random pixel at order 29 of a line: its keys times 1299709, modulo ``PIXELS_29``, exact for all keys of 64 bits.

    The sum of the keys' products leaves 64 bits for keys from about 10^13 on, its product with 1299709 from about 7 million orders on.  So the sum
    is held as ``high`` * 2^32 + ``low``, and ``high`` counts modulo 3 * 2^28.  The remainder has the sum's sign.
    """
    order, part, digits = F.col("l_orderkey"), F.col("l_partkey"), F.lit((1 << 32) - 1)
    low = order.bitwiseAND(digits) * 1000003 + part.bitwiseAND(digits) * 10007
    high = F.shiftright(order, 32) * 1000003 + F.shiftright(part, 32) * 10007 + F.shiftright(low, 32)
    some = F.pmod(high, F.lit(3 << 28)) * 1299709 % (3 << 28)
    pixel = (some * (1 << 32) + low.bitwiseAND(digits) * 1299709) % PIXELS_29
    return F.when((high < 0) & (pixel > 0), pixel - PIXELS_29).otherwise(pixel)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, p29): pseudo-random points of the sky at order 29."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), line_pixels().alias("p29"))


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coinc_id, ifo, snr, time): events as detector triggers; times are seconds of their day."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("coinc_id"), F.col("event_type").alias("ifo"), F.col("value").alias("snr"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, uniq, prob, distmean, diststd): customers as the pixels of four maps with distance."""
    c = table(spark, sf_dir, "customer")
    mean = 100 + F.floor(F.abs("c_acctbal"))
    return c.select((F.col("c_custkey") % 4).alias("map_id"), (F.col("c_custkey") % 49152 + 65536).alias("uniq"), cents("c_acctbal").alias("w"), mean.cast("double").alias("distmean"), (mean * 0.25).alias("diststd"))


FLAT = """flat AS (
    SELECT g.map_id, g.ipix, coalesce(o.w, 0) + 1 AS w
    FROM (SELECT m.map_id, p.ipix FROM range(4) m(map_id), range(192) p(ipix)) g
    LEFT JOIN (SELECT o_custkey % 4 AS map_id, o_orderkey % 192 AS ipix, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS w
               FROM orders GROUP BY 1, 2) o USING (map_id, ipix))"""
SKY = FLAT + """, sky AS (
    SELECT map_id, ipix + 64 AS uniq, 2 AS ord, ipix, w FROM flat WHERE ipix % 4 <> 0
    UNION ALL
    SELECT map_id, 4 * ipix + c + 256, 3, 4 * ipix + c, (w * (c + 1)) // 10 FROM flat, range(4) t(c) WHERE ipix % 4 = 0)"""
POINTS = f"""points AS (
    SELECT l_orderkey AS id, l_linenumber AS line, ((l_orderkey * 1000003 + l_partkey * 10007) * 1299709) % {PIXELS_29} AS p29 FROM lineitem)"""
