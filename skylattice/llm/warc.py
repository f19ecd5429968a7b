"""WARC archives: a deterministic sharded writer and a reader that checks what it reads.

Records are dealt to shards by ranges of their key that hold about the same number of bytes; the bounds come from
exact running sums, so that they depend on the rows and not on how these lay.  A shard is one sorted task.  It writes gzip members, one a
record, and begins a new file when the compressed size of the present one is reached.  Headers and digests are made anew from
the payload.  Files are written under temporary names; those of the attempts that count are renamed by the manifest, and
the manifest itself is the commit: a reader sees all files or none.

Of records with equal payloads the one with the smallest key is a response, the others are revisits without payload.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import schema, shared_folder, spill, text_of

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENDS = b"\r\n\r\n"
#: Our own headers, for what the format has no field for.
KEY, REFERS = "X-Record-Key", "X-Refers-To-Key"
_UNSAFE = re.compile(r"[^\x21-\x7E]")
MOST_SHARDS = 20_000


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, in a task or on the driver."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    parts = urlsplit(folder)
    if parts.scheme == "file":
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: its headers, its block, the two line ends behind it."""
    head = [VERSION, f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _ENDS + block + _ENDS


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time or a name, the same for the same data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _target(url: str | None, key) -> str:
    """The address as a header: what a header can't hold is percent-encoded; without one, a name made of the key."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url) if url else f"urn:record:{'' if key is None else key}"


def _record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}:{digest}')}>"


def page_record(key, url: str | None, payload: bytes | None, size: int, digest: str, date: str, refers: tuple | None) -> bytes:
    """A response with its payload, or a revisit of the record of key ``refers[0]`` and address ``refers[1]``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + _ENDS
    fields = [("WARC-Record-ID", _record_id(key, digest)), ("WARC-Date", date), ("WARC-Target-URI", _target(url, key)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if key is not None:
        fields.append((KEY, str(key)))
    if refers is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers[0], digest)), ("WARC-Refers-To-Target-URI", _target(refers[1], refers[0])), ("WARC-Refers-To-Date", date)]
    if refers[0] is not None:
        fields.append((REFERS, str(refers[0])))
    return record("revisit", fields, http)


class _Files:
    """The files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, file_bytes: int, split_bytes: int, date: str):
        self.fs, self.path = _open(folder)
        self.shard, self.file_bytes, self.split_bytes, self.date = shard, file_bytes, split_bytes, date
        self.number, self.out, self.done = 0, None, []

    def _begin(self) -> None:
        self.temp = f"_temporary/{self.shard:05d}-{self.number:04d}-{uuid.uuid4().hex}.warc.gz"
        self.name = f"part-{self.shard:05d}-{self.number:04d}.warc.gz"
        self.out = self.fs.open_output_stream(posixpath.join(self.path, self.temp), compression=None)
        self.size, self.records, self.splits, self.sha = 0, 0, [0], hashlib.sha256()
        info = f"software: skylattice\r\nformat: {VERSION}\r\n".encode()
        self._put(member(record("warcinfo", [("WARC-Record-ID", _record_id(self.name, "info")), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info)))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        if self.out is not None and self.size >= self.file_bytes:
            self.close()
        if self.out is None:
            self._begin()
        elif self.size - self.splits[-1] >= self.split_bytes:
            self.splits.append(self.size)
        self._put(member(data))
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temp, self.size, self.records, self.sha.hexdigest(), self.splits))
            self.out = None
            self.number += 1


MANIFEST = schema(("name", "string"), ("temp", "string"), ("bytes", "long"), ("records", "long"), ("sha256", "string"), ("splits", "array<long>"))


def _groups(small: DataFrame, least: int) -> DataFrame:
    """(key, digest, refers, refers_url): a row for every record of a payload that occurs several times, with the smallest key that has it.

    A payload held by more than a thousandth of all records is one of a thousand at most: these are broadcast, so that no
    task gets all copies of a page; all others are joined by a shuffle.
    """
    large = small.where(F.col("size") >= least)
    first = F.min_by(F.struct("key", "url"), F.struct(F.col("key").isNull(), F.col("key"), F.col("url").isNotNull(), F.col("url")))
    groups = spill(large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1"), "groups")
    hot_from = max(1, large.count() // 1000)
    wanted = groups.select("digest", F.col("first.key").alias("refers"), F.col("first.url").alias("refers_url"), "n")
    ids = large.select("key", "digest")
    hot = wanted.where(F.col("n") > hot_from).drop("n")
    cold = wanted.where(F.col("n") <= hot_from).drop("n")
    # those of the hot groups leave before the shuffle
    usual = ids.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")
    return ids.join(F.broadcast(hot), "digest").unionByName(usual).distinct()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, shard_bytes: int = 8 << 20, file_bytes: int = 1 << 30, split_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row and return the manifest (name, temp, bytes, records, sha256, splits).

    ``folder`` is new, on storage that driver and executors share.  The payload is the html in UTF-8, null an empty one.
    Of equal payloads of at least ``least`` bytes the record with the smallest key is the response; keys are integers.  Repeated rows: the first is
    the response, the others revisit it.  Null keys come last.  An empty table gives an empty manifest.  Other columns are ignored.

    Shards hold about ``shard_bytes`` of payload, more where there would be over ``MOST_SHARDS``; a page is never split, rows of one key share a
    shard.  Files end behind the record with which they reach ``file_bytes``.  The same rows give the same files byte for byte.
    """
    spark = pages.sparkSession
    fs, path = _open(folder)
    if fs.get_file_info(path).type != pafs.FileType.NotFound and fs.get_file_info(pafs.FileSelector(path)):
        raise ValueError(f"{folder} isn't empty")
    fs.create_dir(posixpath.join(path, "_temporary"), recursive=True)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), text_of(html).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    small = spill(rows.drop("payload"), "records")
    total = small.agg(F.sum("size")).first()[0] or 0
    each = max(shard_bytes, -(-total // MOST_SHARDS))
    # keys at which a running sum of bytes passes a multiple of a shard's: at most MOST_SHARDS of them
    ranged = spill(small.select("key", "size").repartitionByRange(F.asc_nulls_last("key")).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("size").alias("_sum"))
    start = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    upto = F.sum("size").over(Window.partitionBy("_range").orderBy(F.asc_nulls_last("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shard = ranged.withColumn("_upto", upto).join(F.broadcast(start), "_range").withColumn("_upto", F.col("_upto") + F.col("_start"))
    passes = F.floor(F.col("_upto") / each) > F.floor((F.col("_upto") - F.col("size")) / each)
    bounds = np.array(sorted({r[0] for r in shard.where(passes & F.col("key").isNotNull()).select("key").collect()}), np.int64)

    @F.pandas_udf(T.IntegerType())
    def shard_of(k: pd.Series) -> pd.Series:
        known = k.notna()
        return pd.Series(np.where(known, np.searchsorted(bounds, k.fillna(0).to_numpy(np.int64), "left"), len(bounds)).astype(np.int32))

    none = lambda t: F.lit(None).cast(t)
    told = _groups(small, least).select("key", "digest", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), none("long").alias("size"), "refers", "refers_url")
    full = rows.select("key", "digest", F.lit(1).alias("kind"), "url", "payload", "size", none("long").alias("refers"), none("string").alias("refers_url"))
    both = full.unionByName(told).withColumn("shard", shard_of("key"))
    dealt = both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_last("key"), "digest", "kind", F.asc_nulls_last("url"))

    columns = dealt.columns

    def run(batches):
        files, group = None, (None, None, None)
        responded = False
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(k)[i] for k, c in enumerate(columns)}
                k, digest, number = (r[c].as_py() for c in ("key", "digest", "shard"))
                if r["kind"].as_py() == 0:
                    group, responded = (k, digest, (r["refers"].as_py(), r["refers_url"].as_py())), False
                    continue
                if files is None or files.shard != number:
                    if files:
                        files.close()
                        yield from manifest(files)
                    files = _Files(folder, number, file_bytes, split_bytes, date)
                refers = None
                if group[:2] == (k, digest):
                    refers = group[2] if responded or group[2][0] != k else None
                    responded = True
                payload = None if refers else r["payload"].as_buffer().to_pybytes()
                files.add(page_record(k, r["url"].as_py(), payload, r["size"].as_py(), digest, date, refers))
        if files:
            files.close()
            yield from manifest(files)

    def manifest(files):
        if files.done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*files.done), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], MANIFEST.names)

    # the rows of the attempts that ended name the files that count
    written = spill(dealt.mapInArrow(run, MANIFEST), "written")

    def rename(batches):
        fs, path = _open(folder)
        for batch in batches:
            for name, temp, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temp", "bytes"))):
                _commit(fs, posixpath.join(path, temp), posixpath.join(path, name), size)
            yield batch

    # written beside its place and moved there: whoever sees it sees all of it, and every file it names
    written.mapInArrow(rename, MANIFEST).write.parquet(f"{folder}/_temporary/manifest")
    fs.move(posixpath.join(path, "_temporary/manifest"), posixpath.join(path, "_manifest"))
    fs.delete_dir(posixpath.join(path, "_temporary"))
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _commit(fs: pafs.FileSystem, temp: str, final: str, size: int) -> None:
    """Rename, unless another attempt of this task has; the file must be whole."""
    if fs.get_file_info(temp).type == pafs.FileType.File:
        try:
            fs.move(temp, final)
        except OSError:
            if fs.get_file_info(temp).type == pafs.FileType.File:
                raise
    found = fs.get_file_info(final)
    if found.type != pafs.FileType.File or found.size != size:
        raise OSError(f"{final} has {found.size} bytes instead of {size}")


def members(stream, most: int, block: int = 1 << 20):
    """Contents of the gzip members that begin in the next ``most`` bytes of a stream, one at a time."""
    held, read = b"", 0
    while True:
        if not held:
            if read >= most:
                return
            held = stream.read(min(block, most - read))
            read += len(held)
            if not held:
                raise OSError("the archive ends early")
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not held:
                held = stream.read(min(block, most - read))
                read += len(held)
                if not held:
                    raise OSError("a member ends early")
            out.append(z.decompress(held))
            held = z.unused_data if z.eof else b""
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record, its length and block digest checked.  The type of version is under ``version``."""
    head, sep, rest = data.partition(_ENDS)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {"version": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != _ENDS:
        raise ValueError(f"a block of {len(rest) - 4} bytes instead of {size}")
    said = fields.get("warc-block-digest")
    if said and said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("the block isn't that of its digest")
    return fields, block


READ = schema(("key", "long"), ("url", "string"), ("record_type", "string"), ("payload", "binary"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "long"))


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(key, url, record_type, payload, payload_bytes, payload_digest, refers_to) of all records of a committed folder.

    Files are read in parts that begin at records, a part a task; a record at a time is held.  Every length and digest is
    computed anew and compared: what differs raises an error.  A revisit's payload is null, its length and digest are those of the
    payload it stands for, as its headers say.  ``payloads=False`` checks them and leaves them out.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    ends = F.concat(F.slice("splits", 2, F.greatest(F.size("splits"), F.lit(1))), F.array("bytes"))
    parts = manifest.select("name", F.explode(F.arrays_zip(F.col("splits").alias("begin"), ends.alias("end"))).alias("p")).select("name", F.col("p.begin").alias("begin"), F.col("p.end").alias("end"))
    parts = spill(parts.where(F.col("end").isNotNull()), "parts")

    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for name, begin, end in zip(*(batch.column(c).to_pylist() for c in ("name", "begin", "end"))):
                got, held = [], 0
                with fs.open_input_file(posixpath.join(path, name)) as f:
                    f.seek(begin)
                    for data in members(f, end - begin):
                        row = _row(*parse(data), payloads)
                        if row:
                            got.append(row)
                            held += len(row[3] or b"") + 200
                            if held > 4 << 20:
                                yield _batch(got)
                                got, held = [], 0
                if got:
                    yield _batch(got)

    count = max(1, min(parts.count(), 10 * MOST_SHARDS))
    return parts.repartition(count, "name", "begin").mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], READ.names)


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple | None:
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(_ENDS)
    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields.get('warc-record-id')} isn't that of its digest")
    number = lambda name: int(fields[name.lower()]) if name.lower() in fields else None
    return number(KEY), fields.get("warc-target-uri"), kind, payload if kind == "response" and payloads else None, size, digest, number(REFERS)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
