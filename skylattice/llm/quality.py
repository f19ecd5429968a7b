"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is described by
shares of its bytes and words, encoded by a tanh layer, and weighted by gated
attention, softmax(w . (tanh(V h) * sigmoid(U h))); the weighted representation is
scored by a logistic unit.  Only document labels are used in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, crc32_of_id, in_slices, is_space, schema, utf8_column

PASSAGE = 48
_CLASSES = ("upper", "lower", "digit", "stop", "bang", "bar", "hash", "newline", "high", "other")
N_FEATURES = len(_CLASSES) + 8


def _class_table() -> np.ndarray:
    kind = np.full(256, 9, np.uint8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 0, 1, 2, 8
    for k, chars in ((3, ".,;:'\"-()"), (4, "!?"), (5, "|<>[]{}\\/"), (6, "#$%&*@^~_=+"), (7, "\n\r")):
        kind[list(chars.encode())] = k
    return kind


_KIND = _class_table()
_RANDOM = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.int64)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, passages by document) of a UTF-8 column; every document has one passage at least."""
    n = len(offsets) - 1
    space = is_space(data)
    first = ~space
    if len(data):
        first[1:] &= space[:-1]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[starts] = ~space[starts]
    at = np.flatnonzero(first)  # first bytes of words
    doc = np.searchsorted(offsets, at, "right") - 1
    words = np.bincount(doc, minlength=n).astype(np.int64)
    bags = np.maximum(1, -(-words // PASSAGE))
    out = np.zeros((int(bags.sum()), N_FEATURES), np.float32)
    if not len(at):
        return out, bags
    before = np.concatenate([[0], np.cumsum(words)])[:-1]
    nth = np.arange(len(at)) - before[doc]
    bag_start = np.concatenate([[0], np.cumsum(bags)])[:-1]
    passage = bag_start[doc] + nth // PASSAGE  # of each word
    cut = nth % PASSAGE == 0
    cut[0] = True
    edge, of = at[cut], passage[cut]
    kind = _KIND[data]
    # white space before a document's first word belongs to no passage, least of all to the document's before it
    starts_at = np.where(words > 0, at[np.minimum(before, len(at) - 1)], offsets[1:])
    for k in np.flatnonzero(starts_at > offsets[:-1]):
        kind[offsets[k] : starts_at[k]] = 9
    counts = np.zeros((len(edge), len(_CLASSES)), np.float32)
    for k in range(len(_CLASSES)):
        counts[:, k] = np.add.reduceat((kind == k) & ~space if k == 9 else kind == k, edge, dtype=np.int32)
    size = np.maximum(1, counts.sum(axis=1))
    n_words = np.bincount(passage, minlength=len(out))[of].astype(np.float32)
    # a hash of each word, to find repetition
    place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data)))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))])
    mixed = np.where(space, 0, data.astype(np.int64) * _RANDOM[np.minimum(place, 63)])
    code = np.add.reduceat(mixed, at)
    same = np.zeros(len(at), bool)
    same[1:] = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((code, passage))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (code[order][1:] != code[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    repeated = np.bincount(passage, weights=same, minlength=len(out))[of]
    distinct = np.bincount(passage[order], weights=fresh, minlength=len(out))[of]
    long_words = np.bincount(passage, weights=np.add.reduceat(~space, at) > 20, minlength=len(out))[of]
    out[of, : len(_CLASSES)] = counts / size[:, None]
    extra = np.stack([size / n_words / 10, repeated / n_words, distinct / n_words, long_words / n_words, np.log1p(n_words) / 4, counts[:, 6] / n_words, counts[:, 4] / n_words, counts[:, 5] / n_words], axis=1)
    out[of, len(_CLASSES) :] = extra
    return out, bags


class AttentionMIL:
    """Gated-attention model with Adam; a bag's rows are contiguous."""

    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = N_FEATURES
        self.p = {"W": rng.normal(0, f**-0.5, (f, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, attention)), "U": rng.normal(0, hidden**-0.5, (hidden, attention)), "w": rng.normal(0, attention**-0.5, attention), "c": np.zeros(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(f), np.ones(f)

    def forward(self, x, bags):
        p = self.p
        edge = np.concatenate([[0], np.cumsum(bags)])[:-1]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (tv * su) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, edge), bags))
        a /= np.repeat(np.add.reduceat(a, edge), bags)
        z = np.add.reduceat(a[:, None] * h, edge)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return y, (x, edge, h, tv, su, a, z)

    def gradient(self, x, bags, label):
        p = self.p
        y, (x, edge, h, tv, su, a, z) = self.forward(x, bags)
        e = (y - label) / len(label)
        g = {"c": z.T @ e, "d": np.array([e.sum()])}
        dz = np.repeat(e[:, None] * p["c"], bags, axis=0)
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, edge), bags))
        dgate = ds[:, None] * p["w"]
        g["w"] = (tv * su).T @ ds
        dv, du = dgate * su * (1 - tv**2), dgate * tv * su * (1 - su)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
        return g

    def fit(self, x, bags, label, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        edge = np.concatenate([[0], np.cumsum(bags)])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                rows = np.concatenate([np.arange(edge[j], edge[j + 1]) for j in some])
                g = self.gradient(x[rows], bags[some], label[some])
                t += 1
                for k in self.p:
                    g[k] = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 6000, most_passages: int = 128) -> AttentionMIL:
    """Fit on about ``rows`` labelled documents (a bounded sample chosen by a hash of the identifier), of a longer one on
    ``most_passages`` passages spread evenly over it; what comes to the driver is bounded by both.

    Scores always read whole texts.  Rows whose label is null are passed over; a document with several labels is used with each of them.
    Without labelled rows, or with one class only, the model still scores: without rows by its first weights.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_label")).distinct()
    some = about(known, id_col, rows, "quality")
    out = schema(("bags", "int"), ("label", "int"), ("id", "long"), ("x", "binary"))

    def describe(batches):
        for batch in in_slices(batches):
            x, bags = passages(*utf8_column(batch.column(2)))
            edge = np.concatenate([[0], np.cumsum(bags)])
            some = [np.arange(n) if n <= most_passages else np.linspace(0, n - 1, most_passages).astype(int) for n in bags.tolist()]
            raw = [x[edge[i] + k].astype(np.float32).tobytes() for i, k in enumerate(some)]
            bags = np.array([len(k) for k in some])
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.int32()), batch.column(1).cast(pa.int32()), batch.column(0), pa.array(raw, pa.binary())], out.names)

    joined = docs.select(F.col(id_col).cast("long"), text_col).join(F.broadcast(some), id_col)
    found = joined.select(F.col(id_col), F.col("_label"), F.col(text_col).cast("string").alias("text")).mapInArrow(describe, out).collect()
    model = AttentionMIL()
    if found:
        found.sort(key=lambda r: (r.id, r.label, r.x))
        x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in found]).astype(float)
        model.fit(x, np.array([r.bags for r in found]), np.array([r.label for r in found], float))
    return model


def score(docs: DataFrame, model: AttentionMIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a null text is empty and scored as an empty passage.  All passages of a very long text are weighed; equal texts have equal scores.

    Repeated rows give repeated results, an empty table none; other columns are ignored, whatever their names.  One pass over whole texts, batch by batch, without a shuffle.
    """
    out = schema(("id", "long"), ("score", "double"))

    def run(batches):
        for batch in in_slices(batches):
            x, bags = passages(*utf8_column(batch.column(1)))
            y, _ = model.forward(x.astype(float), bags)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y)], out.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out).toDF(id_col, "score")


def keep_good(docs: DataFrame, model: AttentionMIL, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more (a tie stays), all columns as they were.

    A null text is scored as an empty one; repeated rows stay or go together; an empty table stays empty.
    """

    def run(batches):
        for batch in in_slices(batches, column=text_col):
            x, bags = passages(*utf8_column(batch.column(text_col)))
            y, _ = model.forward(x.astype(float), bags)
            yield batch.filter(pa.array(y >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return crc32_of_id(id_col) % 5 == 0
