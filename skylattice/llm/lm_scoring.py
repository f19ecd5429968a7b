"""LM scoring by context-tree weighting over binary-decomposed bytes.

The text that is scored is the normalised one: A-Z in lower case, words joined by one
blank, closed by an end byte.  Each byte is eight binary decisions; every decision
(node of the byte's binary tree) has a context tree over the ``DEPTH`` bytes before it.
A context's counts give a Krichevsky-Trofimov estimate, and weighting mixes the
estimates of all depths: P = 1/2 KT + 1/2 (product of the children's P).  The training
documents fix counts and weights; a context never seen in them leaves the mixture at its
deepest seen suffix, so every prediction is a proper distribution.

Counts of all (context, byte) grams and words are gathered by partial counts and one
shuffle.  Probabilities are worked out once per distinct gram.  Frequent grams and words, a
set of bounded size, are broadcast; all others are looked up by a join, so no case is lost.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, in_slices, schema, spill

DEPTH = 4
END = 0xFF  # never a byte of UTF-8
LN2 = math.log(2.0)
SLICE = 2 << 20  # bytes of text that a worker holds at once


def normal(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at space and the controls 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram at each byte and end, first position of each text): four bytes of context and the byte, as one number."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(first[-1]) + np.repeat(np.arange(1, len(texts) + 1) * DEPTH, lengths)
    key = raw[at].astype(np.int64)
    for d in range(1, DEPTH + 1):
        key |= raw[at - d].astype(np.int64) << (8 * d)
    return key, first[:-1]


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series above 8."""
    x = np.asarray(x, float)
    small = x < 8
    shifted = np.where(small, x + 8, x)
    out = (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    if small.any():
        y = x[small]
        out[small] -= sum(np.log(y + k) for k in range(8))
    return out


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the KT probability of a sequence of so many zeros and ones."""
    return ln_gamma(zeros + 0.5) + ln_gamma(ones + 0.5) - ln_gamma(zeros + ones + 1) - math.log(math.pi)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node 1..255, bit) of the eight decisions of each byte; shape (8, n)."""
    j = np.arange(8)[:, None]
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


class Level:
    """Nodes of one depth: sorted keys, counts, and the weight of their own estimate."""

    def __init__(self, key, zeros, ones, children=None):
        self.key, self.zeros, self.ones = key, zeros, ones
        own = ln_kt(zeros, ones)
        if children is None:
            self.ln_p, self.weight = own, np.ones(len(key))
        else:
            self.ln_p = np.logaddexp(own, children) - LN2
            self.weight = np.exp(np.minimum(0.0, own - LN2 - self.ln_p))

    def up(self, depth: int) -> "Level":
        """The level of depth ``depth`` above this one."""
        key, of = np.unique(self.key & ((1 << (8 * (depth + 1))) - 1), return_inverse=True)
        add = lambda x: np.bincount(of, weights=x, minlength=len(key))
        return Level(key, add(self.zeros), add(self.ones), add(self.ln_p))

    def mix(self, key, bit, below):
        """Mix the prediction ``below`` (NaN: none) with this level's own; NaN where the node isn't there."""
        if not len(self.key):
            return below
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[at] == key
        own = (np.where(bit == 1, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        mixed = np.where(np.isnan(below), own, self.weight[at] * own + (1 - self.weight[at]) * below)
        return np.where(there, mixed, below)


def leaves(key: np.ndarray, n: np.ndarray) -> Level:
    """The deepest level, from grams and their counts."""
    node, bit = decisions(key & 0xFF)
    node_key, of = np.unique(((key >> 8) << 8 | node).ravel(), return_inverse=True)
    n = np.broadcast_to(n, node.shape)
    return Level(node_key, np.bincount(of.ravel(), weights=(n * (1 - bit)).ravel(), minlength=len(node_key)), np.bincount(of.ravel(), weights=(n * bit).ravel(), minlength=len(node_key)))


def subtrees(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels 4, 3 and 2 of all grams that share their last two context bytes; other groups don't disturb."""
    seen = n > 0
    levels = [leaves(key[seen], n[seen].astype(float))]
    for depth in range(DEPTH - 1, 1, -1):
        levels.append(levels[-1].up(depth))
    return levels


def log10_probability(key: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the predicted probability of each gram's byte after its context; levels from the deepest to 0."""
    node, bit = decisions(key & 0xFF)
    full = (key >> 8) << 8 | node
    out = np.full(full.shape, np.nan)
    for depth, level in zip(range(DEPTH, -1, -1), levels):
        out = level.mix(full & ((1 << (8 * (depth + 1))) - 1), bit, out)
    return np.log10(np.where(np.isnan(out), 0.5, out)).sum(axis=0)


_COUNTED = schema(("gram", "long"), ("word", "binary"), ("train", "long"), ("n", "long"))


def gather(docs: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """Counts over all documents of grams (in training, at all) and of the training words; b'' is the end."""

    def run(batches):
        for batch in in_slices(batches, SLICE):
            train = np.array(batch.column(1).to_pylist(), bool)
            words, texts = Counter(), []
            for text, use in zip(batch.column(0).to_pylist(), train):
                own = normal(text)
                texts.append(b" ".join(own))
                if use:
                    words.update(own)
            words[b""] += int(train.sum())
            key, first = grams(texts)
            used = np.repeat(train, np.diff(np.append(first, len(key))))
            key, n = np.unique(key, return_counts=True) if used.all() else np.unique(key << 1 | used, return_counts=True)
            if used.all():
                seen = n
            else:
                seen, key = np.where(key & 1, n, 0), key >> 1
            none = pa.nulls(len(key), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), none, pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))], _COUNTED.names)
            counts = pa.array(list(words.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), counts, counts], _COUNTED.names)

    plain = docs.select(F.col(text_col).cast("string").alias("text"), (~held_out).alias("train"))
    counted = plain.mapInArrow(run, _COUNTED)
    return spill(counted.groupBy("gram", "word").agg(F.sum("train").alias("train"), F.sum("n").alias("n")), "counts")


def frequent(counts: DataFrame, n_col: str, most: int) -> DataFrame:
    """Rows with the largest counts, about ``most`` at most: those above a bound read from a small histogram of counts.

    Of the step that would exceed ``most`` a share chosen by a hash of the key is taken, so that many equal counts don't leave the table empty.
    """
    step = F.floor(F.log2(F.col(n_col)) * 8)
    steps = sorted(((r[0], r[1]) for r in counts.where(F.col(n_col) > 0).groupBy(step.alias("s")).count().collect()), reverse=True)
    total, bound, share = 0, None, 0
    for s, n in steps:
        bound = s
        if total + n > most:
            share = int(0.9 * (most - total) / n * 65536)
            break
        share = 65536
        total += n
    if bound is None:
        return counts.where(F.lit(False))
    some = (step == bound) & (F.pmod(F.xxhash64(F.col(counts.columns[0])), F.lit(65536)) < share)
    return counts.where((F.col(n_col) > 0) & ((step > bound) | some))


class Table:
    """Values of 64-bit keys: a direct-mapped table, and a search for the keys that lost their slot."""

    def __init__(self, key: np.ndarray, value: np.ndarray, bits: int = 19):
        order = np.argsort(key)
        self.key, self.value, self.bits = key[order], value[order], bits
        self.slot_key, self.slot_value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot = self._slot(key[::-1])  # the first given (most frequent) keys write last
        self.slot_key[slot], self.slot_value[slot] = key[::-1], value[::-1]

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values; NaN for keys that aren't there."""
        slot = self._slot(key)
        out = self.slot_value[slot]
        missed = np.flatnonzero(self.slot_key[slot] != key)
        if len(missed):
            if len(self.key):
                at = np.minimum(np.searchsorted(self.key, key[missed]), len(self.key) - 1)
                out[missed] = np.where(self.key[at] == key[missed], self.value[at], np.nan)
            else:
                out[missed] = np.nan
        return out


_LOADED: dict = {}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, head_grams: int = 1 << 18, head_words: int = 1 << 17, per_task: int = 200_000) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``held_out``: a boolean Column of rows that are scored but not learnt from (null: learnt from).
    A null or empty text has one token, the end.  Repeated rows count as often as they
    occur and each gets its row; other columns are ignored, whatever their names, and an empty table gives an empty result.
    Very long texts are scored whole, one at a time.  Without training rows all decisions are even.
    ``head_grams`` and ``head_words`` bound what is broadcast; they change no result.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    counts = gather(docs, id_col, text_col, held_out)
    gram_counts = counts.where("gram is not null").select("gram", "train", "n")
    word_counts = counts.where("word is not null and train > 0").select("word", "train")
    total, distinct = word_counts.agg(F.sum("train"), F.count(F.lit(1))).first()
    total, distinct = total or 0, distinct or 0

    # probabilities of all grams: levels 4 to 2 by their last two context bytes, levels 1 and 0 (bounded) on the driver
    tasks = max(1, -(-gram_counts.count() // per_task))
    by_suffix = gram_counts.repartition(tasks, F.shiftright(F.col("gram"), 8).bitwiseAND(0xFFFF))

    def whole(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        return [np.concatenate(x) for x in zip(*parts)] if parts else None

    def upper(batches):
        got = whole(batches)
        if got:
            two = subtrees(got[0], got[1])[-1]
            yield pa.RecordBatch.from_arrays([pa.array(two.key & 0xFFFF), pa.array(two.zeros), pa.array(two.ones), pa.array(two.ln_p)], ["key", "zeros", "ones", "ln_p"])

    rows = by_suffix.mapInArrow(upper, schema(("key", "long"), ("zeros", "double"), ("ones", "double"), ("ln_p", "double")))
    top = sorted(tuple(r) for r in rows.groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("ln_p")).collect())
    columns = [np.array(x, float) for x in zip(*top)] if top else [np.zeros(0)] * 4
    one = Level(columns[0].astype(np.int64), *columns[1:])
    zero = one.up(0) if len(one.key) else one

    def probabilities(batches):
        got = whole(batches)
        if got:
            p = log10_probability(got[0], [*subtrees(got[0], got[1]), one, zero])
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[2]), pa.array(p)], ["gram", "n", "p"])

    model = spill(by_suffix.mapInArrow(probabilities, schema(("gram", "long"), ("n", "long"), ("p", "double"))), "model")

    # what is frequent goes to every worker
    head = frequent(model, "n", head_grams).select("gram", "n", "p").toArrow()
    order = np.argsort(-head.column("n").to_numpy(), kind="stable")
    known = frequent(word_counts, "train", head_words).toArrow().combine_chunks()
    shipped = spark.sparkContext.broadcast((head.column("gram").to_numpy()[order], head.column("p").to_numpy()[order], known.column("word").to_pylist(), np.log10(known.column("train").to_numpy() + 0.5)))
    tag = uuid.uuid4().hex
    del head, known

    out = schema(("row", "long"), ("id", "long"), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double"), ("n_bytes", "long"), ("gram", "long"), ("word", "binary"), ("n", "long"))

    def run(batches):
        from pyspark import TaskContext

        if tag not in _LOADED:
            key, p, words, value = shipped.value
            _LOADED.clear()
            _LOADED[tag] = (Table(key, p), dict(zip(words, value.tolist())))
        table, value_of = _LOADED[tag]
        serial = TaskContext.get().partitionId() << 36
        for batch in in_slices(batches, SLICE):
            texts, base, known, tokens, rest_word = [], [], [], [], []
            for k, text in enumerate(batch.column(0).to_pylist()):
                own = normal(text)
                texts.append(b" ".join(own))
                own.append(b"")
                values = [value_of.get(w) for w in own]
                if None in values:
                    rest_word += [(serial + k, w, n) for w, n in Counter(w for w, v in zip(own, values) if v is None).items()]
                    values = [v for v in values if v is not None]
                tokens.append(len(own))
                known.append(len(values))
                base.append(math.fsum(values))
            key, first = grams(texts)
            p = table.get(key)
            gone = np.flatnonzero(np.isnan(p))
            p[gone] = 0
            n = len(texts)
            total_p = np.add.reduceat(p, first)
            null = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(serial, serial + n)), batch.column(1), batch.column(2), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total_p), pa.array([len(t) for t in texts], pa.int64()), null(pa.int64()), null(pa.binary()), null(pa.int64())], out.names)
            if len(gone):
                doc = np.searchsorted(first, gone, "right") - 1
                pair, amount = np.unique(np.stack([doc, key[gone]]), axis=1, return_counts=True)
                m = len(amount)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0] + serial), *[pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], pa.array(pair[1]), pa.nulls(m, pa.binary()), pa.array(amount.astype(np.int64))], out.names)
            if rest_word:
                m = len(rest_word)
                row, word, amount = zip(*rest_word)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *[pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], pa.nulls(m, pa.int64()), pa.array(word, pa.binary()), pa.array(amount, pa.int64())], out.names)
            serial += n

    plain = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"))
    scored = spill(plain.mapInArrow(run, out), "scored")
    rows = scored.where("gram is null and word is null")

    # the rest by joins, summed by row
    rest_gram = scored.where("gram is not null").select("row", "gram", "n").join(model.select("gram", "p"), "gram")
    rest_word = scored.where("word is not null").select("row", "word", "n").join(word_counts.select("word", "train"), "word", "left")
    value = F.log10(F.coalesce(F.col("train"), F.lit(0)) + 0.5)
    rest = rest_gram.select("row", (F.col("p") * F.col("n")).alias("p"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k")).unionByName(
        rest_word.select("row", F.lit(0.0).alias("p"), (value * F.col("n")).alias("b"), F.when(F.col("train") > 0, F.col("n")).otherwise(0).cast("long").alias("k"))
    )
    rest = rest.groupBy("row").agg(F.sum("p").alias("p"), F.sum("b").alias("b"), F.sum("k").alias("k"))
    unit = math.log10(total + 0.5 * (distinct + 1))
    zero_ = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score_ = F.col("score") + zero_("p")
    return rows.drop("gram", "word", "n").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("k"), F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero_("b") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), score_.alias("score"),
        (-score_ / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def held_out(id_col: str = "doc_id"):
    return crc32_of_id(id_col) % 5 == 1
