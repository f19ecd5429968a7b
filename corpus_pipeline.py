"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm import exact_dedup, mixing, ngram_join, packing, quality
from skylattice.llm.common import spill, table, text_of


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go.

    A null text is scored as an empty one, a long text whole; a tie at 0.3 stays; repeated rows stay or go together; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~quality.held_out())
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, of equal lengths the smallest identifier.

    Null and empty texts are equal; of rows repeated as a whole one stays; an empty table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more the one with the smallest identifier stays.

    Texts without words are linked with nothing and stay; rows that share an identifier stay or go together; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, also not at all.

    Rows are found again by identifier, source and text.  Several rows alike in all three share their copies exactly,
    the first ones taking the remainder; rows are numbered part by part, so that no group of them meets in one task.
    """
    units = mixing.draw(docs).where("copies > 0").select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("alike").alias("_alike"), "m", "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_own_id"), F.col("source").alias("_own_source"), F.xxhash64(text_of("text")).alias("_text"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_text") == F.col("_alike"))
    taken = rows.join(units.where("m = 1"), same).select("row", F.col("copies").cast("int").alias("_times"))
    if units.where("m > 1").head(1):
        unit = ["_id", "_source", "_alike"]
        several = rows.join(units.where("m > 1"), same).select("row", *unit, "m", "copies").withColumn("_part", F.spark_partition_id())
        several = spill(several.withColumn("_at", F.monotonically_increasing_id()), "alike")
        held = several.groupBy(*unit, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        start = held.select(*[F.col(c).alias(f"{c}2") for c in (*unit, "_part")], before.alias("_before"))
        nth = F.row_number().over(Window.partitionBy(*unit, "_part").orderBy("_at")) - 1
        on = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in (*unit, "_part")]
        numbered = several.withColumn("_nth", nth).join(start, on)
        times = mixing.nth_copies(F.col("_nth") + F.col("_before"))
        taken = taken.unionByName(numbered.select("row", times.cast("int").alias("_times")).where("_times > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, with the ids of each piece.

    A null text is its end alone; long texts fill sequences of their own; repeated rows are packed as rows; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: No SQL: four of the five stages are models, samplers or packers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill(docs, "stage")
    return docs
