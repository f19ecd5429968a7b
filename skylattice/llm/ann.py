"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into parts of equal size
with few edges between them; a small neural classifier learns the part of a vector, and
offsets of its outputs keep the parts of all rows about equal.  Rows are indexed by their most
probable part; a query is routed to its several most probable parts and reranked there by
exact distances.  How many parts are searched is measured: on rows kept from training, against their
true neighbours among all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import about, schema, spill

FOUND = schema(("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "double"))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector isn't null, empty, zero, or holding null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def neighbours(x: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of each row, by blocks."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), block):
        d = square[None, :] - 2 * x[i : i + block] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[i : i + block] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """Part of each row: recursive bisection, begun by the main axis and bettered by swaps of balanced pairs."""
    label = np.zeros(len(x), np.int64)
    a = np.repeat(np.arange(len(x)), near.shape[1])
    b = near.ravel()
    for level in range(int(np.log2(parts))):
        side = np.zeros(len(x), np.int64)
        members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label, minlength=1 << level))[:-1])
        for rows in members:
            if len(rows) < 2:
                continue
            y = x[rows] - x[rows].mean(axis=0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            side[rows[np.argsort(y @ axis, kind="stable")[len(rows) // 2 :]]] = 1
        inside = label[a] == label[b]
        ea, eb = a[inside], b[inside]
        for _ in range(rounds):
            differs = np.where(side[ea] != side[eb], 1, -1)
            gain = np.bincount(ea, weights=differs, minlength=len(x)) + np.bincount(eb, weights=differs, minlength=len(x))
            moved = 0
            for rows in members:
                left, right = rows[side[rows] == 0], rows[side[rows] == 1]
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                better = np.flatnonzero(gain[left[:m]] + gain[right[:m]] <= 2)
                m = min(better[0] if len(better) else m, max(1, len(rows) // 10))
                if m and gain[left[:m]].sum() + gain[right[:m]].sum() > 0:
                    side[left[:m]], side[right[:m]] = 1, 0
                    moved += m
            if not moved:
                break
        label = label * 2 + side
    return label


@dataclass
class Router:
    """Classifier with one hidden layer; ``probes`` parts are searched for a query."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = ((x - self.mean) / self.scale).astype(np.float32)
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` most probable parts of each row, in that order."""
        score = -self.logits(x)
        if k >= self.parts:
            return np.argsort(score, axis=1, kind="stable")
        some = np.sort(np.argpartition(score, k - 1, axis=1)[:, :k], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)


def learn(x: np.ndarray, parts: int, near: int = 10, hidden: int = 128, epochs: int = 12, batch: int = 256, rate: float = 2e-3, seed: int = 0) -> Router:
    """Router from a sample: cut its neighbour graph, learn the parts of a row and of its neighbours, even out the parts."""
    x = np.unique(x, axis=0)  # copies of a vector say nothing on the graph
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    d = x.shape[1]
    parts = min(parts, 1 << max(0, int(np.log2(max(1, len(x) // 16)))))
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    f = np.float32
    r = Router(mean, scale, rng.normal(0, (2 / d) ** 0.5, (d, hidden)).astype(f), np.zeros(hidden, f), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)).astype(f), np.zeros(parts, f))
    if parts < 2:
        return r
    k = min(near, len(x) - 1)
    graph = neighbours(x, k)
    label = partition_graph(x, graph, parts)
    names = ("w1", "b1", "w2", "b2")
    m = {q: np.zeros_like(getattr(r, q)) for q in names}
    v = {q: np.zeros_like(getattr(r, q)) for q in names}
    scaled = ((x - mean) / scale).astype(f)
    t = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            z = scaled[rows]
            h = np.maximum(0, z @ r.w1 + r.b1)
            o = h @ r.w2 + r.b2
            p = np.exp(o - o.max(axis=1, keepdims=True))
            e = p / p.sum(axis=1, keepdims=True)
            own = np.arange(len(rows))
            e[own, label[rows]] -= 0.5  # half for its own part, half for those of its neighbours
            np.subtract.at(e, (np.repeat(own, k), label[graph[rows]].ravel()), f(0.5 / k))
            e /= len(rows)
            back = (e @ r.w2.T) * (h > 0)
            t += 1
            for q, g in zip(names, (z.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[q] = f(0.9) * m[q] + f(0.1) * g
                v[q] = f(0.999) * v[q] + f(0.001) * g * g
                step = rate * (1 - epoch / epochs)
                setattr(r, q, (getattr(r, q) - f(step) * (m[q] / f(1 - 0.9**t)) / (np.sqrt(v[q] / f(1 - 0.999**t)) + f(1e-8))).astype(f))
    even = len(x) / parts
    for _ in range(30):
        held = np.bincount(r.logits(x).argmax(axis=1), minlength=parts)
        r.b2 = (r.b2 - f(0.2) * np.log((held + 0.1 * even) / (1.1 * even))).astype(f)
    return r


def measured(rows: DataFrame, router: Router, asked: np.ndarray, k: int, wanted: float) -> int:
    """The least number of parts that hold ``wanted`` of the true ``k`` neighbours, among all rows, of the vectors ``asked``."""
    out = schema(("q", "int"), ("d", "double"), ("part", "int"))
    square = (asked * asked).sum(axis=1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            part = router.best(x, 1)[:, 0]
            for i in range(0, len(x), 2048):
                y = x[i : i + 2048]
                d = np.maximum(0, (y * y).sum(axis=1)[None, :] - 2 * asked @ y.T + square[:, None])
                d[d <= 1e-12 * (1 + square[:, None])] = np.inf  # the row itself, and its copies
                n = min(k, len(y))
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), n), pa.int32()), pa.array(np.take_along_axis(d, near, 1).ravel()), pa.array(part[i : i + 2048][near].ravel(), pa.int32())], out.names)

    order = Window.partitionBy("q").orderBy("d", "part")
    found = rows.select("v").mapInArrow(run, out).where(F.col("d") < float("inf")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("q", "part").collect()
    if not found:
        return 1
    place = np.argsort(router.best(asked, router.parts), axis=1)
    rank = np.sort([place[r.q, r.part] for r in found])
    return int(rank[min(len(rank) - 1, int(np.ceil(wanted * len(rank))) - 1)]) + 1


def fit(rows: DataFrame, sample: int = 20_000, per_part: int = 128, most_parts: int = 512, apart: int = 200, k: int = 10, wanted: float = 0.95) -> Router | None:
    """Router from about ``sample`` of the usable rows; None where there are none.

    There is a part for every ``per_part`` rows, ``most_parts`` at most.  Of a table with more rows than the sample ``apart`` rows
    are kept from training; with them the number of parts to search is measured against all rows.
    """
    n = rows.count()
    got = about(rows, "vec_id", sample, "ann").select("v").toArrow().column(0).combine_chunks()
    if not len(got):
        return None
    x = got.flatten().to_numpy().reshape(len(got), -1)
    x = x[np.random.default_rng(1).permutation(len(x))[np.argsort(np.lexsort(x.T[:2]), kind="stable")]]  # by value, then shuffled
    parts = 1 << max(1, min(int(np.log2(most_parts)), int(np.ceil(np.log2(max(2, n / per_part))))))
    apart = min(apart, len(x) // 10)
    router = learn(x[apart:], parts)
    router.probes = measured(rows, router, x[: max(1, apart)], k, wanted) if router.parts > 1 else 1
    return router


def _nearest_of(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, y: np.ndarray, k: int):
    """(query, candidate, distance) of the ``k`` nearest of each query in one set of rows; ties to the smaller identifier."""
    square = (x * x).sum(axis=1)
    found = []
    for i in range(0, len(y), 256):
        z, own_ids = y[i : i + 256], asked[i : i + 256]
        own = (z * z).sum(axis=1)
        d = square[None, :] - 2 * z @ x.T + own[:, None]
        d[own_ids[:, None] == ids[None, :]] = np.inf
        m = min(k, len(ids))
        bound = np.partition(d, m - 1, axis=1)[:, m - 1] + 1e-9 * (square.max() + own)
        q, c = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        exact = np.sqrt(((x[c] - z[q]) ** 2).sum(axis=1))
        order = np.lexsort((ids[c], exact, q))
        q, c, exact = q[order], c[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        found.append((own_ids[q[keep]], ids[c[keep]], exact[keep]))
    return [np.concatenate(f) for f in zip(*found)] if found else None


def search(rows: DataFrame, router: Router, queries: DataFrame, k: int = 10, block_rows: int = 20_000, block_queries: int = 2_000, per_group: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` nearest found by Euclidean distance.

    ``rows`` and ``queries`` have (vec_id, v).  Rows of a query's own identifier are no candidates; ties go to
    the smaller vec_id.  ``per_group`` neighbouring parts of the recursive bisection go together, so that a
    query is sent once to each group that it probes.  Groups are dealt in blocks of about
    ``block_rows`` rows and ``block_queries`` queries, so one that holds a third of all rows is as many tasks.  A query
    whose parts hold fewer than ``k`` candidates is sent to all other parts too.
    """

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                part = router.best(x, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(part // per_group, pa.int32()), pa.array(part, pa.int32()), *batch.columns], ["grp", "part", "vec_id", "v"])

    def route(rest: bool):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                order = router.best(x, router.parts)
                probed = np.zeros((len(x), -(-router.parts // per_group) * per_group), bool)
                np.put_along_axis(probed, order[:, router.probes :] if rest else order[:, : router.probes], True, axis=1)
                groups = probed.reshape(len(x), -1, per_group)
                for g in np.flatnonzero(groups.any(axis=(0, 2))):
                    some = np.flatnonzero(groups[:, g].any(axis=1))
                    which = [np.flatnonzero(m) + g * per_group for m in groups[some, g]]
                    taken = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g), pa.int32()), pa.array([w.tolist() for w in which], pa.list_(pa.int32())), *taken.columns], ["grp", "parts", "vec_id", "v"])

        return run

    indexed = spill(rows.select("vec_id", "v").mapInArrow(index, schema(("grp", "int"), ("part", "int"), ("vec_id", "long"), ("v", "array<double>"))), "index")
    cells = indexed.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("rows"))
    out = schema(("query_id", "long"), ("vec_id", "long"), ("score", "double"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            a = a.sort_values(["part", "vec_id"], kind="stable")
            ids, part, x = a["vec_id"].to_numpy(), a["part"].to_numpy(), np.stack(a["v"].to_numpy()).astype(float)
            asked, y = b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()).astype(float)
            wants = b["parts"].to_numpy()
            who = np.repeat(np.arange(len(b)), [len(w) for w in wants])
            what = np.concatenate(wants)
            for p in np.unique(part):
                some = slice(*np.searchsorted(part, [p, p + 1]))
                q = who[what == p]
                got = _nearest_of(ids[some], x[some], asked[q], y[q], k) if len(q) else None
                if got:
                    found.append(got)
        if not found:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q, v, s = (np.concatenate(f) for f in zip(*found))
        order = np.lexsort((v, s, q))  # the best of this cell
        q, v, s = q[order], v[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pd.DataFrame({"query_id": q[keep], "vec_id": v[keep], "score": s[keep]})

    def meet(asked: DataFrame, rest: bool) -> DataFrame:
        asked = spill(asked.select("vec_id", "v").mapInArrow(route(rest), schema(("grp", "int"), ("parts", "array<int>"), ("vec_id", "long"), ("v", "array<double>"))), "queries")
        asks = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("asks"))
        grid = F.broadcast(cells.join(asks, "grp"))  # a row for each group of parts: most_parts / per_group at most
        left = indexed.join(grid, "grp").withColumn("r", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("rows")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        right = asked.join(grid, "grp").withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("asks")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        return left.select("grp", "r", "q", "part", "vec_id", "v").groupBy("grp", "r", "q").cogroup(right.select("grp", "r", "q", "parts", "vec_id", "v").groupBy("grp", "r", "q")).applyInPandas(near, out)

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(FOUND.names)

    first = spill(ranked(meet(queries, False)), "found")
    if router.probes >= router.parts:
        return first
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = spill(queries.join(full, "vec_id", "left_anti"), "short")
    if not short.head(1):
        return first
    return ranked(first.drop("rank").unionByName(meet(short, True)))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, **options) -> DataFrame:
    """Neighbours of the rows whose identifier is divisible by ``every``, among all usable rows.

    Rows with a null identifier, or a vector that is null, empty, zero, or holds null or non-finite components, take no
    part.  There is no distance between vectors of different lengths: each length is searched on its own.  Several rows of one identifier
    make one query (of the smallest vector) and are one candidate each; an empty table gives an empty result and
    other columns are ignored.  ``options`` go to ``fit``.
    """
    rows = spill(usable(vectors, id_col, vector_col).withColumn("_size", F.size("v")), "vectors")
    sizes = sorted(r[0] for r in rows.select("_size").distinct().collect())  # one row for each length of vectors
    out = None
    for size in sizes:
        own = rows.where(F.col("_size") == size).drop("_size")
        queries = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        if queries.head(1):
            found = search(own, fit(own, sample, k=k, **options), queries, k)
            out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], FOUND) if out is None else out
