import os

import pytest

import corpus_pipeline
from skylattice.llm import exact_dedup, ngram_join
from skylattice.llm.common import spill

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spill(stage(spark, docs, SF), "test")
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert docs.count() <= n
            n = docs.count()
        if k == 1:
            assert exact_dedup.exact_dedup(docs).where("NOT kept").count() == 0
        if k == 2:
            rows = ngram_join.join_classes(docs).collect()
            assert all(r.doc_id == r.component_id for r in rows)
    sums = {}
    for p in docs.collect():
        sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
    assert all(s == 1024 or s & (s - 1) == 0 for s in sums.values())


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 14))
