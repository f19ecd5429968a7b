"""Fill-in-middle: every output against a plain version, with documents of one chunk and of thousands."""

import hashlib
import re

import numpy as np
import pytest

from skylattice.llm import infilling

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rate=50, spm=80, seed="42"):
    text = text or ""
    tokens = TOKENS.findall(text)
    n = len(tokens)
    held = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(held[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = np.random.default_rng(1)
    parts = ["a", "bc", "<", "<P", "P>", "<S", ">", " ", "  ", "\n", "\t", "\x0b", "é", "😀", "M>", "SPM", " ", "\x1f", "<M"]
    out = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(300)]
    return [*out, "x<P>y", "<S>", "a<M> ", "<<M>>", None, "", " ", "\n\n", "word", " lead", "trail ", "<P", "<P", "é" * 300 + " " + "w " * 500, "no space at all" * 50]


def same(rows):
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text), r
        assert r.back == r.text


@pytest.mark.parametrize("chunk,giant", [(1 << 14, 1 << 16), (7, 50), (1, 0), (2, 10)])
def test_against_a_plain_version(spark, chunk, giant):
    rows = [(k, t) for k, t in enumerate(texts())]
    got = infilling.transform(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, giant=giant).withColumn("back", infilling.restored()).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    same(got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_a_giant_document_is_scanned_by_many_tasks(spark):
    text = " ".join(f"wörd{k}" for k in range(60_000)) + "  \n"
    got = infilling.transform(spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string")).withColumn("back", infilling.restored()).collect()
    same(got)
    assert {r.n for r in got} == {60_001}


def test_nulls_repeats_clashes_and_empty_tables(spark, docs, none):
    got = infilling.transform(docs, keep=("source",)).withColumn("back", infilling.restored()).collect()
    assert len(got) == docs.count() and {r.source for r in got} == {"a", "b", "c", None}
    same(got)
    assert infilling.digest(infilling.transform(none)).collect() == []
    with pytest.raises(ValueError):
        infilling.transform(docs.withColumnRenamed("source", "form"), keep=("form",))


def test_rates(spark):
    rows = spark.createDataFrame([(k, "some words to cut") for k in range(50)], "doc_id long, text string")
    assert {r.form for r in infilling.transform(rows, rate=0).collect()} == {"plain"}
    assert {r.form for r in infilling.transform(rows, rate=100, spm_rate=0).collect()} == {"psm"}


def test_composition_is_associative():
    rng = np.random.default_rng(0)
    data = rng.choice(np.frombuffer(b"ab <>PSM\n", np.uint8), 200)
    at = np.array([0, 1, 2, 5, 40, 41, 100, 200])
    step, counts, _ = infilling.functions(data, at)
    whole, total, _ = infilling.functions(data, np.array([0, 200]))
    by_doubling = infilling.compose(step, counts, np.arange(7))
    assert (by_doubling[0][-1] == whole[0]).all() and (by_doubling[1][-1] == total[0]).all()
    for s in range(infilling.STATES):  # one byte after the other
        state, seen = s, np.zeros(2, int)
        for b in data:
            c = infilling.CLASS[b]
            seen += infilling.COUNTS[:, state, c]
            state = infilling.NEXT[state, c]
        assert state == whole[0, s] and (seen == total[0, s]).all()
