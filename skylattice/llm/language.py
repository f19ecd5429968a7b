"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3) of the lower-cased letters, a blank
standing for anything between them.  Weights are trained by follow-the-regularised-leader
with an elastic-net penalty, which leaves most of them at zero; a temperature fitted
on rows kept apart calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, in_slices, schema, utf8_column

BITS = 13
WIDTH = 1 << BITS
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Class of each code point of the first plane: 0 for what isn't a letter, else its lower-case form."""
    import sys

    plane = np.zeros(0x10000, np.int64)
    for k in range(0x10000):
        if 0xD800 <= k < 0xE000:
            continue
        c = chr(k)
        if c.isalpha():
            plane[k] = ord(c.lower()[0])
    assert sys.maxunicode > 0xFFFF
    return plane


_PLANE: list = []


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each character, document of each character) of a UTF-8 column."""
    if not _PLANE:
        _PLANE.append(_letters())
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    code = data[at].astype(np.int64)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        p, first = at[wide], code[wide]
        one, two, three = padded[p + 1] & 0x3F, padded[p + 2] & 0x3F, padded[p + 3] & 0x3F
        code[wide] = np.where(first < 0xE0, (first & 0x1F) << 6 | one, np.where(first < 0xF0, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three))
    kind = _PLANE[0][np.minimum(code, 0xFFFF)]
    beyond = np.flatnonzero(code > 0xFFFF)
    if len(beyond):  # emoji and scripts of the upper planes: each distinct one is looked up once
        found, of = np.unique(code[beyond], return_inverse=True)
        kind[beyond] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in found.tolist()], np.int64)[of]
    return kind, np.searchsorted(offsets, at, "right") - 1


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the hashed n-grams, number of letters) by document."""
    n = len(offsets) - 1
    kind, doc = characters(data, offsets)
    letters = np.bincount(doc[kind > 0], minlength=n)
    if len(kind):
        again = np.zeros(len(kind), bool)  # one blank for all that stands between two letters
        again[1:] = (kind[1:] == 0) & (kind[:-1] == 0) & (doc[1:] == doc[:-1])
        kind, doc = kind[~again], doc[~again]
    total = np.zeros(n * WIDTH, np.float32)
    key = np.zeros(len(kind), np.uint64)
    for order in range(3):
        # key of the n-gram that ends at each character; one that would cross into a document counts for none
        if order == 0:
            key, end = kind.astype(np.uint64), doc
        else:
            key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + kind[order:].astype(np.uint64) + np.uint64(order)
            end = doc[order:]
        inside = end == doc[: len(end)]
        code = (key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
        total += np.bincount(end[inside] * WIDTH + code[inside].astype(np.int64), minlength=n * WIDTH).astype(np.float32)
    return total.reshape(n, WIDTH), letters


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weight: np.ndarray  # (features, labels)
    bias: np.ndarray
    temperature: float = 1.0

    def tfidf(self, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf
        return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def ftrl(x: np.ndarray, y: np.ndarray, n_labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, batch: int = 16, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic net; small batches in a seeded order."""
    f = x.shape[1]
    z, n = np.zeros((f + 1, n_labels)), np.zeros((f + 1, n_labels))
    rng = np.random.default_rng(seed)

    def weights(some):
        w = -(z[some] - np.sign(z[some]) * l1) / ((beta + np.sqrt(n[some])) / alpha + l2)
        w[np.abs(z[some]) <= l1] = 0
        return w

    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            some = np.append(np.flatnonzero(x[rows].any(axis=0)), f)
            part = np.hstack([x[rows][:, some[:-1]], np.ones((len(rows), 1))])
            w = weights(some)
            p = part @ w
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = part.T @ p
            sigma = (np.sqrt(n[some] + g * g) - np.sqrt(n[some])) / alpha
            z[some] += g - sigma * w
            n[some] += g * g
    w = weights(np.arange(f + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the smallest log-loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all of ``docs``, and their number."""
    out = schema(("feature", "int"), ("n", "long"))

    def run(batches):
        held, rows = np.zeros(WIDTH, np.int64), 0
        for batch in in_slices(batches, 1 << 20):
            for part in _chunks(batch):
                count, _ = counts(*utf8_column(part.column(0)))
                held += (count > 0).sum(axis=0)
                rows += len(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH), pa.int32()), pa.array(np.append(rows, held))], out.names)

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, out).groupBy("feature").agg(F.sum("n").alias("n")).collect()
    frequency, rows = np.zeros(WIDTH), 0
    for feature, n in found:
        if feature < 0:
            rows = n
        else:
            frequency[feature] = n
    return frequency, rows


def _chunks(batch, most: int = 256):
    for start in range(0, batch.num_rows, most):
        yield batch.slice(start, most)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 4000, least: int = 100, most: int = 512) -> LanguageModel:
    """Fit on the rows whose language is not null.

    Document frequencies are counted over all of them; weights are fitted on about ``rows`` of them, and on about ``least`` of
    each language at the least, so that a rare one can be learnt from tables of any size.  The sample is chosen by a
    hash of identifier and text; a fifth is kept for the temperature.  ``most`` languages are learnt, the most frequent ones, so that a column of other things can't
    fill the driver.
    Without any labelled row there is no language to learn and all is undetermined.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    each = known.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most)
    number = {r[0]: r[1] for r in each.collect()}  # one row for each language
    total = sum(number.values())
    frequency, n = document_frequency(known, text_col)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    out = schema(("lang", "string"), ("id", "long"), ("feature", "binary"), ("amount", "binary"))

    def describe(batches):
        for batch in in_slices(batches, 1 << 20):
            for part in _chunks(batch):
                count, letters = counts(*utf8_column(part.column(2)))
                rows = [np.flatnonzero(c) if n else np.zeros(0, np.int64) for c, n in zip(count, letters)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array([r.astype(np.int16).tobytes() for r in rows], pa.binary()), pa.array([c[r].tobytes() for c, r in zip(count, rows)], pa.binary())], out.names)

    every = {lang: max(1, min(-(-total // rows), n // least)) for lang, n in number.items()}
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in every.items() for x in pair]), F.col(lang_col).cast("string")), F.lit(0)) if every else F.lit(1)
    some = known.where(rate > 0).where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("language")), F.greatest(rate, F.lit(1))) == 0).select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(text_col).cast("string").alias("text"))
    found = [r for r in some.mapInArrow(describe, out).collect() if r.feature]
    labels = sorted({r.lang for r in found})
    model = LanguageModel(labels, idf.astype(np.float32), np.zeros((WIDTH, max(1, len(labels))), np.float32), np.zeros(max(1, len(labels))))
    if not found:
        return model
    found.sort(key=lambda r: (r.id is None, r.id or 0, r.lang, r.feature))
    x = np.zeros((len(found), WIDTH), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r.feature, np.int16)] = np.frombuffer(r.amount, np.float32)
        x[k] = model.tfidf(x[k : k + 1])[0]
    y = np.array([labels.index(r.lang) for r in found])
    apart = np.arange(len(found)) % 5 == 4
    w, b = ftrl(x[~apart], y[~apart], len(labels))
    model.weight, model.bias = w.astype(np.float32), b
    model.temperature = temperature(model.logits(x[apart]), y[apart])
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, in one pass over whole texts.

    A null text, or one without a letter, is ``und`` with score 0.  Of languages equally likely the
    first by code point is taken.  Repeated rows give repeated results, an empty table none; very long texts are read whole and
    other columns are ignored, whatever their names.
    """
    out = schema(("id", "long"), ("lang_pred", "string"), ("score", "double"))

    def run(batches):
        for batch in in_slices(batches, 1 << 20):
            for part in _chunks(batch):
                count, letters = counts(*utf8_column(part.column(1)))
                none = (letters == 0) | (not model.labels)
                p = model.probability(model.tfidf(count)).astype(float)
                best = p.argmax(axis=1)
                names = [UNDETERMINED if empty else model.labels[k] for k, empty in zip(best, none)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, np.minimum(1.0, p[np.arange(len(p)), best])))], out.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out).toDF(id_col, "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    return crc32_of_id(id_col) % 3 == 1
