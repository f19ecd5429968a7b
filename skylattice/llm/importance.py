"""Importance resampling towards a target distribution, by an external sort-count.

Every text becomes a stream of 16-bit buckets, one for each feature (a run of words), packed behind those of other
texts with the offsets of each: written once, two bytes a feature.  The streams are sorted and run-length encoded where they
lie, and runs of equal buckets are added up: the counts.  A bucket's gain is the logarithm of its share in the target
over its share in the corpus.  The same streams are read again, the gains gathered, and
``np.add.reduceat`` adds them within the offsets.  Texts are read once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, schema, spill, text_of, utf8_column

MOST_BUCKETS = 1 << 16
_LONG_WORD = 64  # bytes; longer ones are hashed one by one


def _fold() -> np.ndarray:
    """Bytes in lower case; 0 for all that belongs to no word.  Words are digits, letters and all beyond ASCII."""
    t = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        t[low:high] = np.arange(low, high)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


FOLD, CRC = _fold(), _crc_table()


def _feed(crc: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running crc32 states (not yet inverted at the end) after the words ``data[start:start + size]``, all at once."""
    out = crc.copy()
    for k in np.flatnonzero(size > _LONG_WORD):
        word = data[start[k] : start[k] + size[k]].tobytes()
        out[k] = zlib.crc32(word, int(crc[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(size <= _LONG_WORD)
    by = short[np.argsort(-size[short], kind="stable")]  # those that still have a byte stand in front
    state, at, left = out[by], start[by], size[by]
    n = len(by)
    for j in range(int(left[0]) if n else 0):
        n = int(np.searchsorted(-left[:n], -j, "left"))
        state[:n] = CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[by] = state
    return out


def streams(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, offsets of each text's, words of each text) of texts that lie one behind the other.

    A text's features are its words, then its runs of two, and so on up to ``longest``.
    """
    plain = FOLD[data]
    inside = np.concatenate(([False], plain != 0, [False]))
    # a word ends where its text ends
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    at = np.searchsorted(start, offsets)  # the first word of each text
    words = np.diff(at)
    doc = np.repeat(np.arange(len(words)), words)
    state = _feed(np.full(len(start), 0xFFFFFFFF, np.uint32), plain, start, size)
    runs, owner, begun = [state], [doc], np.arange(len(start))
    for n in range(2, longest + 1):
        k = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
        state = runs[-1][np.searchsorted(begun, k)]
        state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _feed(state, plain, start[k + n - 1], size[k + n - 1])
        begun = k
        runs.append(state)
        owner.append(doc[k])
    bucket = ((np.concatenate(runs) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.uint16)
    whose = np.concatenate(owner)
    if longest > 1:
        by = np.argsort(whose, kind="stable")
        bucket, whose = bucket[by], whose[by]
    return bucket, np.searchsorted(whose, np.arange(len(words) + 1)), words


def write_streams(docs: DataFrame, key: str | None, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(keys, offsets, words, stream): packed streams of many texts a row, written once to the shared folder."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"a bucket has 16 bits: between 1 and {MOST_BUCKETS} buckets")
    plain = docs.select((F.col(key) if key else F.lit(None)).cast("long").alias("_key"), text_of(text_col).alias("text"))
    out = schema(("keys", "array<long>"), ("offsets", "array<long>"), ("words", "array<long>"), ("stream", "binary"))

    def run(batches):
        for batch in in_slices(batches):
            data, offsets = utf8_column(batch.column("text"))
            bucket, at, words = streams(data, offsets, longest, buckets)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (batch.column("_key").to_pylist(), at, words)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([bucket.astype("<u2").tobytes()], pa.binary())], out.names)

    return spill(plain.mapInArrow(run, out), "streams")


def counts(written: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features in every bucket.  Streams are sorted and run-length encoded in place; a task gives a row for each bucket at most, which
    Spark adds up: ``buckets`` rows, 65,536 at most, come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                run_ = np.sort(np.frombuffer(stream.as_buffer(), "<u2"), kind="stable")
                heads = np.flatnonzero(np.concatenate(([True], run_[1:] != run_[:-1]))) if len(run_) else np.zeros(0, int)
                total[run_[heads]] += np.diff(np.append(heads, len(run_)))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    rows = written.select("stream").mapInArrow(run, schema(("bucket", "int"), ("n", "long"))).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)) of every bucket, one added to each count."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + k) / ((int(s) + 1) * (t_all + k)))) for s, t in zip(corpus, target)], np.int64)


def weigh(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_features, words, weight) of every text: the floored mean of its features' gains, 0 without any."""

    def run(batches):
        for batch in batches:
            for keys, offsets, words, stream in zip(*(batch.column(k) for k in range(4))):
                at = offsets.values.to_numpy()
                picked = gain[np.frombuffer(stream.as_buffer(), "<u2")]
                size = np.diff(at)
                full = np.flatnonzero(size)
                total = np.zeros(len(size), np.int64)
                if len(full):
                    total[full] = np.add.reduceat(picked, at[full])
                weight = np.floor_divide(total, np.maximum(size, 1))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(size), words.values, pa.array(weight)], ["key", "n_features", "words", "weight"])

    return written.mapInArrow(run, schema(("key", "long"), ("n_features", "long"), ("words", "long"), ("weight", "long")))


def gumbel(key: str, seed: str):
    """floor(-1000 * ln(-ln(u))) with u drawn by the hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add the place of every row in a total order: dealt by range, numbered within each range, and the sizes of the ranges before it added."""
    dealt = spill(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range; their running sum is one small task
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, nth).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(key, n_features, weight, score, rank): every document with its importance, and the drawn ones with their rank.

    Features are runs of 1 to ``longest`` words, hashed to ``buckets``.  ``percent`` of the documents of at least ``least_words`` words are drawn
    without replacement, in proportion to the exponential of their weight (in thousandths): those with the highest score, the
    weight with Gumbel noise by the hash of seed and key; ties to the smaller key.

    Null texts have no features and weigh 0; a null key hashes like an empty one and comes last among ties.  Repeated rows are
    scored alike and ranked one after the other.  Empty tables give no rows; an empty target has the same share in all buckets.  Other columns
    are ignored, whatever their names.  Texts of any length count whole.
    """
    written = write_streams(docs, key, text_col, longest, buckets)
    gain = gains(counts(written, buckets), counts(write_streams(target, None, target_text, longest, buckets), buckets))
    # floors of sums fit in 64 bits: a text has less than 2^31 features of less than 2^16 thousandths each
    scored = spill(weigh(written, gain).withColumn("score", F.col("weight") + gumbel("key", seed)), "scores")
    may = scored.where(F.col("words") >= least_words)
    most = percent * may.count() // 100
    drawn = ranked(may, [F.desc("score"), F.asc_nulls_last("key")])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
