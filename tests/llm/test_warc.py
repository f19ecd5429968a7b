"""WARC: round trips, files that depend on the rows alone, rolling, commits, damaged archives."""

import gzip
import hashlib
from collections import defaultdict

import pytest

from skylattice.llm import warc

PAGE = "<html><body>" + "x" * 120


def rows():
    out = [(k, f"http://a/{k}", f"{PAGE}{k % 7}</body>") for k in range(60)]
    return out + [(60, None, None), (61, "http://b/ü ?\r\nX: y", ""), (62, "http://c", "short"), (63, "http://c", "short"), (64, "http://d", "é😀\r\n\r\nWARC/1.1\r\n" * 9), (65, "http://e", PAGE * 3000), (66, "http://e", PAGE * 3000), (None, "http://f", PAGE + "0</body>"), (None, None, None)]


def expected(pages, least=100):
    held = defaultdict(list)
    for key, _, html in pages:
        held[html or ""].append(key)
    out = []
    for key, _, html in pages:
        payload = (html or "").encode()
        first = min((k for k in held[html or ""] if k is not None), default=None)
        again = len(payload) >= least and key != first
        out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None, None if again else payload))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def read(spark, folder):
    return sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, folder).collect()), key=str)


def local(folder):
    return warc._open(folder)[1]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 1000, "file_bytes": 300, "split_bytes": 100}, {"shard_bytes": 2000, "file_bytes": 1 << 20, "split_bytes": 1}])
def test_round_trip(spark, sizes):
    folder = warc.new_folder(spark)
    manifest = warc.write(frame(spark, rows()).repartition(5), folder, **sizes).collect()
    assert sum(m.records for m in manifest) == len(rows())
    assert read(spark, folder) == expected(rows())
    if "file_bytes" in sizes and sizes["file_bytes"] == 300:
        assert len(manifest) > 20 and len({m.name.split("-")[1] for m in manifest}) > 5
    for m in manifest:
        data = open(f"{local(folder)}/{m.name}", "rb").read()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256 and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_files_depend_on_the_rows_alone(spark):
    held = []
    for parts in (1, 7):
        folder = warc.new_folder(spark)
        warc.write(frame(spark, rows()).repartition(parts), folder, shard_bytes=3000, file_bytes=1000)
        held.append({m.name: m.sha256 for m in spark.read.parquet(f"{folder}/_manifest").collect()})
    assert held[0] == held[1] and len(held[0]) > 3


def test_repeated_rows_and_hot_payloads(spark):
    pages = [(k, "http://a", PAGE) for k in range(300)] + [(5, "http://a", PAGE)] * 3 + [(k, "http://a", f"{PAGE}{k // 2}") for k in range(1000, 2000)]
    folder = warc.new_folder(spark)
    warc.write(frame(spark, pages), folder, shard_bytes=5000)
    assert read(spark, folder) == expected(pages)
    twice = warc.new_folder(spark)
    warc.write(frame(spark, [(1, "http://a", PAGE)] * 3), twice)
    assert sorted((r[3], r[4]) for r in read(spark, twice)) == [("response", None), ("revisit", 1), ("revisit", 1)]


def test_empty_tables_clashing_columns_and_used_folders(spark):
    folder = warc.new_folder(spark)
    more = frame(spark, rows()).selectExpr("*", "'a' AS key", "1 AS shard", "2 AS kind", "3 AS payload")
    assert warc.write(more.limit(0), folder).collect() == [] and read(spark, folder) == []
    other = warc.new_folder(spark)
    warc.write(more, other)
    assert read(spark, other) == expected(rows())
    with pytest.raises(ValueError):
        warc.write(more, other)


def test_headers(spark):
    folder = warc.new_folder(spark)
    (m,) = warc.write(frame(spark, [(1, "http://b/ü ?\r\nX: y", PAGE), (2, "http://c", PAGE)]), folder).collect()
    data = gzip.decompress(open(f"{local(folder)}/{m.name}", "rb").read())
    assert b"\r\nX: y" not in data and b"WARC-Target-URI: http://b/%C3%BC%20?%0D%0AX:%20y\r\n" in data
    got = [warc.parse(x) for x in warc.members(open(f"{local(folder)}/{m.name}", "rb"), m.bytes, 7)]
    one, two = got[1][0], got[2][0]
    assert two["warc-refers-to"] == one["warc-record-id"] and two["warc-refers-to-target-uri"] == one["warc-target-uri"] and two["warc-profile"] == warc.REVISIT_PROFILE
    assert two["warc-payload-digest"] == one["warc-payload-digest"] and PAGE.encode() not in got[2][1]


def test_damage_is_found(spark):
    folder = warc.new_folder(spark)
    (m,) = warc.write(frame(spark, [(1, "http://b", PAGE)]), folder).collect()
    record = [*warc.members(open(f"{local(folder)}/{m.name}", "rb"), m.bytes)][1]
    for bad in (record.replace(b"xx", b"xy", 1), record[:-5], record.replace(b"Content-Length: ", b"Content-Length: 9"), b"HTTP" + record):
        with pytest.raises(ValueError):
            warc.parse(bad)
    fields, block = warc.parse(record)
    with pytest.raises(ValueError):
        warc._row({**fields, "warc-payload-digest": "sha256:00"}, block, True)
    with open(f"{local(folder)}/{m.name}", "r+b") as f:
        f.truncate(m.bytes - 3)
    with pytest.raises(Exception, match="ends early"):
        warc.read(spark, folder).collect()


def test_a_renamed_file_may_be_renamed_again(spark, tmp_path):
    fs, _ = warc._open(str(tmp_path))
    (tmp_path / "t").write_bytes(b"abc")
    warc._commit(fs, str(tmp_path / "t"), str(tmp_path / "f"), 3)
    warc._commit(fs, str(tmp_path / "t"), str(tmp_path / "f"), 3)  # another attempt of the task
    with pytest.raises(OSError):
        warc._commit(fs, str(tmp_path / "t"), str(tmp_path / "f"), 4)


def test_uncommitted_folders_are_not_read(spark):
    folder = warc.new_folder(spark)
    warc.write(frame(spark, rows()), folder)
    fs, path = warc._open(folder)
    fs.move(f"{path}/_manifest", f"{path}/_gone")
    with pytest.raises(Exception):
        warc.read(spark, folder).collect()
