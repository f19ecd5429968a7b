"""Exact dedup by a tree-merge of sorted digest runs (DataFrame operations only).

Every input partition is a *run*: its digests, sorted and counted.  Runs are merged along the
binomial tree of their numbers.  A level does log2(``fan_in``) binomial rounds at once: the runs
whose numbers differ in the next bits only exchange their entries by ranges of digests, so a piece
of the merged run (one range of one parent) meets in one place, is brought in order, and a
streaming aggregate over the ordered entries merges equal digests, keeping their count and their smallest
candidate.  Pieces are written in order, so what the next level's sorter gets are ordered stretches.  An
entry's sort key is a 64-bit hash; two entries are one only if the SHA-256 of the
normalised text agrees too, which verifies each merge at every level.

The way down the same tree tells every run the outcome of the digests that
occur more than once.  A digest has at most ``fan_in`` children at each node and a
run at the bottom is one input partition, so a group of copies, however large, never
meets in one task, neither on the way up (one entry per run) nor on the way down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE_RE, spill, text_of

_KEY = ["_hash", "_sha"]
#: Digests of a piece, about, at the top of the tree.
PIECE = 4096


def leaf_run(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: identifier, length, digests and the number of its run."""
    text = text_of(text_col)
    normal = F.regexp_replace(text, WHITESPACE_RE, "")
    run = docs.select(
        F.col(id_col).alias("_id"),
        F.length(text).cast("long").alias("_chars"),
        F.xxhash64(text).alias("_raw"),
        normal.alias("_normal"),
    )
    run = run.select(
        "_id", "_chars", "_raw", F.xxhash64("_normal").alias("_hash"), F.unhex(F.sha2("_normal", 256)).alias("_sha"),
        F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().alias("_row"),
    )
    return spill(run.sortWithinPartitions("_run", *_KEY), "run")


def merged(entries: DataFrame, bits: int, leaf: bool = False) -> DataFrame:
    """Entries (_run, digest, _n, _best) of sorted runs, merged by run and digest; written in that order.

    A piece is a run's range of digests: the upper ``bits`` of the hash.  The aggregate needs no exchange and
    no sort of its own beyond the exchange by pieces and the order within them.  Rows of a ``leaf`` aren't distinct yet: they
    are counted before they are exchanged.
    """
    dealt = entries.withColumn("_piece", F.shiftrightunsigned("_hash", 64 - bits))
    if not leaf:
        dealt = dealt.repartition("_run", "_piece").sortWithinPartitions("_run", "_piece", *_KEY)
    out = dealt.groupBy("_run", "_piece", *_KEY).agg(F.sum("_n").alias("_n"), F.min("_best").alias("_best"))
    return spill(out.drop("_piece"), "level")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, raw_hash and chars.

    Texts are equal when identical after deleting white space; a null text is empty.
    Of equal texts the row with the most code points stays, then the smallest
    identifier (a null identifier comes last), then, for repeated rows, one of them.
    Other columns of ``docs`` are ignored, whatever their names; an empty table gives an empty result.  Very
    long texts are read whole, but only digests are exchanged.  ``fan_in`` is a power of two.
    """
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in is a power of two")
    leaf = leaf_run(docs, id_col, text_col)
    last, rows = leaf.agg(F.max("_run"), F.count(F.lit(1))).first()
    runs = (last or 0) + 1
    bits = max(12, (rows // PIECE).bit_length())
    best = F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    levels = [merged(leaf.select("_run", *_KEY, F.lit(1).cast("long").alias("_n"), best.alias("_best")), bits, leaf=True)]
    while runs > 1:
        runs = -(-runs // fan_in)
        levels.append(merged(levels[-1].withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")), bits))
    outcome = levels.pop().where("_n > 1").select("_run", *_KEY, F.col("_n").alias("_total"), F.col("_best").alias("_keep"))
    for level in reversed(levels):
        children = level.select("_run", *_KEY).withColumn("_parent", F.floor(F.col("_run") / fan_in).cast("int"))
        parents = outcome.withColumnRenamed("_run", "_parent")
        outcome = children.join(parents, ["_parent", *_KEY]).select("_run", *_KEY, "_total", "_keep")
    keep = F.when(F.col("_total").isNull(), F.col("_id")).otherwise(F.col("_keep._id"))
    return leaf.join(outcome, ["_run", *_KEY], "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("_total"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_keep._row") == F.col("_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.col("_raw").alias("raw_hash"),
        F.col("_chars").alias("chars"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by identifier and hash of the raw text.  Rows repeated as a
    whole share both; they alone are dealt out once more, and one of each stays.
    """
    rows = exact_dedup(docs, id_col, text_col)
    # kept rows, and how many rows of the table look like each of them
    alike = rows.groupBy(F.col(id_col).alias("_id"), F.col("raw_hash").alias("_raw")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_alike"))
    alike = spill(alike.where("_kept").select("_id", "_raw", "_alike"), "kept")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_own"), F.xxhash64(text_of(text_col)).alias("_hash"))
    match = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_raw"))
    single = keyed.join(alike.where("_alike = 1"), match, "left_semi").select("row.*")
    if not alike.where("_alike > 1").head(1):
        return single
    again = keyed.join(alike.where("_alike > 1"), match, "left_semi").dropDuplicates(["_own", "_hash"]).select("row.*")
    return single.unionByName(again)
