"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skylattice.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    held = [(k, *features(t, longest)) for k, t in docs]
    s = Counter(bucket(f) for _, _, fs in held for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * (s_all + buckets) / ((s[bucket(f)] + 1) * (t_all + buckets))))
    out = []
    for k, words, fs in held:
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    may = sorted((o for o in out if o[4] >= least), key=lambda o: (-o[3], o[0] is None, o[0]))
    most = percent * len(may) // 100
    return [(*o[:4], k + 1 if k < most else None) for k, o in enumerate(may)] + [(*o[:4], None) for o in out if o[4] < least]


def table():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)] + ["Ärger", "ärger", "ABC", "a_b", "x-y", "日本", "z" * 70, "0", "é😀"]
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(200)]
    return docs + [(200, None), (201, ""), (202, " .,\n"), (203, "y" * 100_000 + " " + "w1 " * 5000), (204, "ends"), (205, "begins")], [" ".join(rng.choice(words[:10], 30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 10_000, 10), (2, 7, 100), (1, 65_536, 0)])
def test_against_brute_force(spark, longest, buckets, percent):
    docs, target = table()
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=percent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs, target, longest, buckets, percent)))


def test_nulls_repeats_ties_clashes_and_empty_tables(spark, docs, none):
    target = spark.createDataFrame([("one two",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.resample(docs, target, percent=100, least_words=0).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, ["one two"], percent=100, least=0)))
    assert sorted(r.rank for r in got) == list(range(1, len(rows) + 1))
    assert importance.resample(none, target).collect() == []
    assert len(importance.resample(docs, target.limit(0)).collect()) == len(rows)
    with pytest.raises(ValueError):
        importance.write_streams(docs, "doc_id", buckets=70_000)


def test_words_end_where_texts_end():
    data = np.frombuffer(b"abcdeab", np.uint8)
    bucket, at, words = importance.streams(data, np.array([0, 0, 3, 3, 5, 7, 7]), 2, 10_000)
    assert at.tolist() == [0, 0, 1, 1, 2, 3, 3] and words.tolist() == [0, 1, 0, 1, 1, 0]
    assert bucket.tolist() == [zlib.crc32(w) % 10_000 for w in (b"abc", b"de", b"ab")]
