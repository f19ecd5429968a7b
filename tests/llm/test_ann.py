"""Nearest neighbours against brute force, with parts that are skipped."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import ann


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) + rng.integers(0, 4, 1500)[:, None]
    x[200:500] = x[200]
    rows = [(k, [float(np.float32(v)) for v in x[k]]) for k in range(1500)]
    rows += [(1500, None), (1501, [0.0] * 16), (1502, [float("nan")] * 16), (1503, [1.0] * 3), (1600, [float("inf")] + [0.0] * 15), (300, rows[300][1])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest(t, sample=1000).collect()
    x = np.array([r[1] for r in rows[:1500]])
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 100))
    hit = 0
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and q not in {f[1] for f in found}
        assert all(s == pytest.approx(d[v]) for _, v, s in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 10 * len(by)
    assert ann.nearest(t.limit(0)).count() == 0


def brute(rows, q, k=10):
    d = sorted((float(np.sqrt(((np.array(v) - np.array(rows[q])) ** 2).sum())), i) for i, v in rows.items() if i != q)
    return [i for _, i in d[:k]]


def clustered(n=6000, d=16, clusters=60, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, d)) * 3
    x = centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * 0.4
    return {k: [float(np.float32(v)) for v in x[k]] for k in range(n)}


def test_recall_where_most_parts_are_skipped(spark):
    rows = clustered()
    t = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").repartition(4)
    router = ann.fit(ann.usable(t), sample=2000)
    assert router.parts >= 32 and router.probes <= router.parts // 4
    held = np.bincount(router.best(np.array(list(rows.values())), 1)[:, 0], minlength=router.parts)
    assert held.max() < 4 * len(rows) / router.parts
    got = defaultdict(list)
    for r in ann.nearest(t, sample=2000).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, 6000, 100)) and {len(v) for v in got.values()} == {10}
    assert sum(len(set(v) & set(brute(rows, q))) for q, v in got.items()) >= 0.9 * 10 * len(got)


def test_queries_whose_parts_hold_too_few_are_filled(spark):
    rows = clustered(400, clusters=8)
    t = ann.usable(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>"))
    router = ann.fit(t, per_part=16)
    router.probes = 1
    queries = t.where("vec_id % 20 = 0")
    got = defaultdict(list)
    for r in ann.search(t, router, queries, k=60, block_rows=40, block_queries=3).collect():
        got[r.query_id].append(r.vec_id)
    assert {len(v) for v in got.values()} == {60} and len(got) == 20
    few = ann.nearest(spark.createDataFrame([(k, rows[k]) for k in range(5)], "vec_id long, embedding array<float>"), every=2)
    assert sorted((r.query_id, r.rank) for r in few.collect()) == [(q, k) for q in (0, 2, 4) for k in range(1, 5)]


def test_lengths_ties_and_extra_columns(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (100, [1.0, 1.0, 1.0]), (101, [1.0, 1.0, 2.0]), (200, [5.0]), (None, [1.0, 0.0]), (300, [])]
    t = spark.createDataFrame([(*r, 9, 8) for r in rows], "vec_id long, embedding array<float>, v int, part int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(t).collect()}
    assert got == {(0, 1): (1, 0.0), (0, 2): (2, 0.0), (0, 3): (3, 1.0), (100, 1): (101, 1.0)}
    assert ann.nearest(t).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.nearest(t.where(F.lit(False))).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(640, 8))
    label = ann.partition_graph(x, ann.neighbours(x, 5), 16)
    assert set(np.bincount(label)) == {40}
    with pytest.raises(ValueError):
        ann.neighbours(x[:3], 5)
