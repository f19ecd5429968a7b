"""Maps in FITS files: a binary-table reader and writer, also as a Spark data source.

Only what maps need is read: 80-byte cards, 2880-byte blocks, one binary table, plain or
gzipped.  Files are read through Spark's binary reader, so any path that Spark can read works.
"""

from __future__ import annotations

import contextlib
import datetime
import gzip
import math
import posixpath
import re
import shlex
import textwrap
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import healpix
from ..functions.gps import gps_of, iso8601_of, mjd_of
from ..functions.types import fields, kind

#: Metadata of a map and the cards that hold it.  Fixed values of the format.
CARDS = {
    "objid": ("OBJECT", "Unique identifier for this event"),
    "url": ("REFERENC", "URL of this event"),
    "instruments": ("INSTRUME", "Instruments that triggered this event"),
    "gps_time": ("DATE-OBS", "UTC date of the observation"),
    "gps_creation_time": ("DATE", "UTC date of file creation"),
    "creator": ("CREATOR", "Program that created this file"),
    "origin": ("ORIGIN", "Organization responsible for this FITS file"),
    "runtime": ("RUNTIME", "Runtime in seconds of the CREATOR program"),
    "distmean": ("DISTMEAN", "Posterior mean distance (Mpc)"),
    "diststd": ("DISTSTD", "Posterior standard deviation of distance (Mpc)"),
    "log_bci": ("LOGBCI", "Log Bayes factor: coherent vs. incoherent"),
    "log_bsn": ("LOGBSN", "Log Bayes factor: signal vs. noise"),
    "vcs_version": ("VCSVERS", "Software version"),
    "vcs_revision": ("VCSREV", "Software revision (Git)"),
    "build_date": ("DATE-BLD", "Software build date"),
}
_CODES = {"L": "?", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
UNITS = {"PROBDENSITY": "sr-1", "PROB": "pix-1", "DISTMU": "Mpc", "DISTSIGMA": "Mpc", "DISTNORM": "Mpc-2"}


def normal_id(value):
    """An integer where the value is one or ends in one as in table:column:12, else the text."""
    text = str(value)
    m = re.match(r"^(?:\w+:\w+:)?(\d+)$", text)
    return int(m[1]) if m else text


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)'", text)[1].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        return float(text.replace("D", "E")) if text else None


def headers(data: bytes) -> Iterator[tuple[dict, int, int]]:
    """(cards, first byte of data, bytes of data) of each unit; HISTORY and COMMENT are lists."""
    at = 0
    while at + 2880 <= len(data):
        cards: dict = {}
        done = False
        while not done:
            block = data[at : at + 2880]
            if len(block) < 2880:
                raise ValueError("the file ends within a header")
            at += 2880
            for k in range(0, 2880, 80):
                card = block[k : k + 80].decode("ascii", "replace")
                name = card[:8].rstrip()
                if name == "END":
                    done = True
                    break
                if name in ("HISTORY", "COMMENT"):
                    cards.setdefault(name, []).append(card[8:].rstrip())
                elif card[8:10] == "= ":
                    cards[name] = _value(card[10:])
        size = abs(cards.get("BITPIX", 8)) // 8 * math.prod(cards.get(f"NAXIS{k}", 0) for k in range(1, cards.get("NAXIS", 0) + 1)) if cards.get("NAXIS") else 0
        size += cards.get("PCOUNT", 0)
        yield cards, at, size
        at += -(-size // 2880) * 2880


def parse(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """(cards, columns) of the first binary table; vector columns are flattened row by row."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for cards, at, _ in headers(data):
        if str(cards.get("XTENSION", "")).strip() != "BINTABLE":
            continue
        types, names = [], []
        for k in range(1, cards["TFIELDS"] + 1):
            m = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"])
            n, code = int(m[1] or 1), m[2]
            if code not in _CODES:
                raise ValueError(f"columns of type {code} aren't supported")
            names.append(str(cards.get(f"TTYPE{k}", f"COL{k}")).strip())
            types.append((names[-1], _CODES[code], (n,)) if n > 1 else (names[-1], _CODES[code]))
        rows = np.frombuffer(data, np.dtype(types), cards["NAXIS2"], at)
        return cards, {n: np.ascontiguousarray(rows[n]).reshape(-1) for n in names}
    raise ValueError("the file holds no binary table")


def standardize(cards: dict, columns: dict, nested: bool = True) -> dict[str, np.ndarray]:
    """Columns in lower case with int64 uniq or ipix; rasters are put in the order asked for."""
    if str(cards.get("COORDSYS", "C")).strip() not in ("C", "C       "):
        raise ValueError("only equatorial maps are supported (COORDSYS = C)")
    out = {}
    for name, x in columns.items():
        name = {"PROBABILITY": "PROB"}.get(name.upper(), name.upper()).lower()
        out[name] = x.astype(np.int64 if name in ("uniq", "ipix") else x.dtype.newbyteorder("="))
    if "uniq" in out:
        return out
    order = str(cards.get("ORDERING", "")).strip()
    if order not in ("RING", "NESTED", "NUNIQ"):
        raise ValueError(f"unknown ORDERING {order!r}")
    n = len(next(iter(out.values())))
    level = int(round(math.log2(math.sqrt(n / 12))))
    ipix = out.pop("ipix", np.arange(n))
    if (order == "NESTED") != nested:
        ipix = healpix.ring2nest(level, ipix) if nested else healpix.nest2ring(level, ipix)
    return {"ipix": ipix, **out}


#: How values are turned into those of a card, and back.
CONVERTERS = {
    "objid": (normal_id, normal_id),
    "instruments": (lambda v: ",".join(sorted({v} if isinstance(v, str) else set(v))), lambda v: sorted({x.strip() for x in str(v).split(",")} - {""})),
    "gps_time": (iso8601_of, gps_of),
    "gps_creation_time": (iso8601_of, gps_of),
}


def version_metadata(version: str, revision: str | None = None, build_date: str | None = None, package: str = "skylattice") -> dict:
    """Metadata that names the software: version with its package, revision, date."""
    return {"vcs_version": f"{package} {version}", "vcs_revision": revision, "build_date": build_date}


def provenance(program: str, arguments: list[str], started: float, ended: float) -> dict:
    """Metadata of a run: creator, creation time (GPS), runtime in seconds, and its command line as history lines."""
    lines = textwrap.wrap(" ".join([program, *map(shlex.quote, arguments)]), 70)
    return {"creator": program, "gps_creation_time": gps_of(datetime.datetime.fromtimestamp(ended, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")), "runtime": round(ended - started, 6), "history": ["", "Generated by calling the following:", *lines]}


def metadata(cards: dict) -> dict:
    """Metadata by its names, times in GPS seconds; None where a card isn't there."""
    out = {}
    for k, (card, _) in CARDS.items():
        value = cards.get(card)
        out[k] = CONVERTERS[k][1](value) if value is not None and k in CONVERTERS else value
    out["history"] = cards.get("HISTORY", [])
    return out


def _card(name: str, value, comment: str = "") -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20d}"
    elif isinstance(value, float):
        text = f"{value!r:>20}".upper()
    else:
        text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'"
    return f"{name:<8}= {text}{' / ' + comment if comment else ''}"[:80].ljust(80).encode("ascii", "replace")


def serialize(columns: dict[str, np.ndarray], meta: dict | None = None, nested: bool = True) -> bytes:
    """A FITS file of one map: multi-resolution where there is ``uniq`` (sorted by it), else a whole raster."""
    meta = meta or {}
    multi = "uniq" in columns
    key = columns["uniq"] if multi else columns["ipix"]
    by = np.argsort(key, kind="stable")
    names = [n for n in columns if n != "ipix"]
    codes = {"i8": "K", "i4": "J", "f8": "D", "f4": "E", "i2": "I"}
    kinds = [(n.upper(), columns[n].dtype.newbyteorder(">")) for n in names]
    rows = np.empty(len(key), np.dtype(kinds))
    for n in names:
        rows[n.upper()] = columns[n][by]
    cards = [_card("XTENSION", "BINTABLE", "binary table"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", rows.dtype.itemsize), _card("NAXIS2", len(rows)), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(names))]
    for k, (n, t) in enumerate(kinds, 1):
        cards += [_card(f"TTYPE{k}", n), _card(f"TFORM{k}", codes[t.str[1:]])]
        if n in UNITS:
            cards.append(_card(f"TUNIT{k}", UNITS[n]))
    cards += [_card("PIXTYPE", "HEALPIX", "HEALPIX pixelisation"), _card("ORDERING", "NUNIQ" if multi else "NESTED" if nested else "RING"), _card("COORDSYS", "C", "Ecliptic, Galactic or Celestial (equatorial)")]
    if multi:
        order = int(np.max((np.frexp(np.maximum(key, 4).astype(float))[1] - 1) // 2 - 1)) if len(key) else 0
        cards += [_card("MOCORDER", order, "MOC resolution (best order)"), _card("INDXSCHM", "EXPLICIT", "Indexing: IMPLICIT or EXPLICIT")]
    else:
        cards += [_card("NSIDE", int(round(math.sqrt(len(key) / 12)))), _card("INDXSCHM", "IMPLICIT", "Indexing: IMPLICIT or EXPLICIT")]
    for k, (card, comment) in CARDS.items():
        if meta.get(k) is not None:
            cards.append(_card(card, CONVERTERS[k][0](meta[k]) if k in CONVERTERS else meta[k], comment))
            if k == "gps_time":
                cards.append(_card("MJD-OBS", mjd_of(meta[k]), "modified Julian date of the observation"))
    for line in meta.get("history", []):
        cards.append(f"HISTORY {line}"[:80].ljust(80).encode("ascii", "replace"))
    pad = lambda b, c: b + c * (-len(b) % 2880)
    first = b"".join([_card("SIMPLE", True, "conforms to FITS standard"), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True), b"END".ljust(80)])
    return pad(first, b" ") + pad(b"".join(cards) + b"END".ljust(80), b" ") + pad(rows.tobytes(), b"\0")


def read_maps(spark: SparkSession, path: str, columns: tuple[str, ...] = ("probdensity",), moc: bool = True, nested: bool = True) -> DataFrame:
    """All maps under ``path`` (globs allowed) as one table: path, uniq or ipix, columns.

    Files are dealt by Spark's binary reader, one task for several files; columns not asked for aren't kept.
    """
    key = "uniq" if moc else "ipix"
    out = fields("path:string," + key + ":long" + "".join(f",{c}:double" for c in columns))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cards, raw = parse(content)
                got = standardize(cards, raw, nested)
                if key not in got and key == "uniq":
                    order = int(round(math.log2(math.sqrt(len(got["ipix"]) / 12))))
                    got["uniq"] = got["ipix"] + 4 ** (order + 1)
                    if "prob" in got:
                        got["probdensity"] = got["prob"] / (4 * math.pi / len(got["ipix"]))
                if key not in got:
                    raise ValueError(f"{name} holds a multi-resolution map; rasterize it first")
                n = len(got[key])
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(got[key]), *[pa.array(got[c].astype(float)) if c in got else pa.nulls(n, pa.float64()) for c in columns]], out.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, out)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each map: path and metadata as text."""
    names = list(CARDS)
    out = fields("path:string," + ",".join(f"{n}:string" for n in names))

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(p, *[None if v is None else str(v) for v in (metadata(parse(c)[0])[n] for n in names)]) for p, c in zip(b["path"], b["content"])], columns=out.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, out)


class _Part(InputPartition):
    def __init__(self, path):
        self.path = path


def file_system(path: str):
    """(file system, path in it) of a local path or a URI, for tasks that write files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(pattern: str) -> list[str]:
    """Files that a pattern names, on a local disk or by URI on any file system: ``*``, ``?`` and ``[...]`` in every part of the path."""
    from fnmatch import fnmatchcase

    from pyarrow import fs

    system, name = file_system(pattern)
    lead = pattern[: len(pattern) - len(name)] if "://" in pattern else ""
    special = lambda text: any(c in text for c in "*?[")
    parts = name.split("/")
    fixed = next((k for k, p in enumerate(parts) if special(p)), len(parts))
    if fixed == len(parts):
        return [pattern] if system.get_file_info(name).type == fs.FileType.File else []
    found = ["/".join(parts[:fixed])]
    for k in range(fixed, len(parts)):
        last, step = k == len(parts) - 1, []
        for folder in found:
            for x in system.get_file_info(fs.FileSelector(folder or ("/" if name.startswith("/") else "."), allow_not_found=True)):
                if fnmatchcase(x.base_name, parts[k]) and x.type == (fs.FileType.File if last else fs.FileType.Directory):
                    step.append(x.path)
        found = step
    return sorted(lead + x for x in found)


@contextlib.contextmanager
def saved(path: str):
    """A stream to a file that is there whole or not at all: beside its place first, then moved."""
    system, name = file_system(path)
    held = f"{name}.{uuid.uuid4().hex}.part"
    system.create_dir(posixpath.dirname(name) or ".", recursive=True)
    try:
        with system.open_output_stream(held) as f:
            yield f
        system.move(held, name)
    except BaseException:
        remove(held if "://" not in path else path + held[len(name) :])
        raise


def save(data: bytes, path: str) -> None:
    """Write a file that is there whole or not at all."""
    with saved(path) as f:
        f.write(data)


def remove(path: str) -> None:
    """Remove a file; silent where there is none."""
    system, name = file_system(path)
    try:
        system.delete_file(name)
    except FileNotFoundError:
        pass


class SkymapReader(DataSourceReader):
    """One partition for each file; rows come as Arrow batches."""

    def __init__(self, schema, options):
        self.schema, self.path = schema, options["path"]

    def partitions(self):
        return [_Part(p) for p in list_files(self.path)] or [_Part(self.path)]

    def read(self, partition):
        import pyarrow as pa

        system, name = file_system(partition.path)
        with system.open_input_file(name) as f:
            cards, raw = parse(f.read())
        got = standardize(cards, raw)
        n = len(next(iter(got.values())))
        types = {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}
        columns = []
        for field in self.schema.fields:
            t = types[field.dataType.simpleString()]
            columns.append(pa.array(got[field.name]).cast(t) if field.name in got else pa.nulls(n, t))
        yield pa.RecordBatch.from_arrays(columns, self.schema.names)


class _Written(WriterCommitMessage):
    def __init__(self, held: str | None):
        self.held = held


class SkymapWriter(DataSourceWriter):
    """One file from one partition: each task writes beside the file, and the commit moves it there.

    Rows in several partitions would be several maps and are an error, as is a file that exists unless it may be overwritten.
    """

    def __init__(self, schema, options, overwrite=False):
        self.schema, self.path, self.overwrite = schema, options["path"], overwrite

    def write(self, iterator):
        rows = list(iterator)
        if not rows:
            return _Written(None)
        columns = {n: np.array([r[k] for r in rows], np.int64 if n in ("uniq", "ipix") else float) for k, n in enumerate(self.schema.names)}
        held = f"{self.path}.{uuid.uuid4().hex}.part"
        save(serialize(columns), held)
        return _Written(held)

    def commit(self, messages):
        held = [m.held for m in messages if m is not None and m.held]
        system, name = file_system(self.path)
        there = system.get_file_info(name).type.name != "NotFound"
        if len(held) > 1 or (there and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"{self.path} exists" if len(held) <= 1 else "a file holds one map from one partition: coalesce(1), or write_maps for several maps")
        if held:
            system.move(file_system(held[0])[1], name)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.held:
                remove(m.held)


class SkymapSource(DataSource):
    """``spark.read.format("skymap_fits")`` and ``df.coalesce(1).write.format("skymap_fits")``."""

    @classmethod
    def name(cls):
        return "skymap_fits"

    def schema(self):
        return kind("struct<uniq:long,probdensity:double>")

    def reader(self, schema):
        return SkymapReader(schema, self.options)

    def writer(self, schema, overwrite):
        return SkymapWriter(schema, self.options, overwrite)


def write_map(df: DataFrame, path: str, meta: dict | None = None, nested: bool = True) -> None:
    """One map to one file, made in one task and moved to its place whole; .gz is compressed."""
    write_maps(df.withColumn("_map", F.lit("map")), path, "_map", meta, nested, name=lambda key: "").collect()


def write_maps(df: DataFrame, folder: str, key: str = "map_id", meta: dict | None = None, nested: bool = True, name=lambda key: f"/{key}.fits", columns: tuple[str, ...] | None = None) -> DataFrame:
    """One FITS file for each map, written by the task that holds it: (map_id, path, bytes), once an action runs.

    ``folder`` is on storage that executors share (a path mounted everywhere, or a URI).  Files appear whole, and a task that is
    run again replaces its file by the same one.  ``name`` gives a file's name behind the folder from its key.
    """
    kept = [c for c in (columns or df.columns) if c != key]

    def one(k: tuple, rows):
        import pandas as pd

        path = folder + name(k[0])
        data = serialize({n: rows[n].to_numpy() for n in kept}, meta, nested)
        data = gzip.compress(data, mtime=0) if path.endswith(".gz") else data
        save(data, path)
        return pd.DataFrame([(str(k[0]), path, len(data))], columns=["map_id", "path", "bytes"])

    return df.select(key, *kept).groupBy(key).applyInPandas(one, fields("map_id:string,path:string,bytes:long"))


def write_moc(region: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """The cells (uniq) of a region as MOC files of one column, one for each ``key``: (map_id, path, bytes).

    Four sibling cells that are all there are written as their parent.
    """
    cells = region.select(F.lit("moc").alias("_map") if key is None else F.col(key).alias("_map"), "uniq").distinct()

    def one(k: tuple, rows):
        import pandas as pd

        out = path if key is None else f"{path}/{k[0]}.moc.fits"
        data = serialize({"uniq": merged_cells(rows["uniq"].to_numpy(np.int64))}, {"creator": "skylattice"})
        save(data, out)
        return pd.DataFrame([(str(k[0]), out, len(data))], columns=["map_id", "path", "bytes"])

    return cells.groupBy("_map").applyInPandas(one, fields("map_id:string,path:string,bytes:long"))


def merged_cells(uniq: np.ndarray) -> np.ndarray:
    """A set of cells with complete groups of four siblings replaced by their parents, from fine to coarse."""
    now = np.unique(uniq)
    for order in range(29, 0, -1):
        here = (now >= 4 ** (order + 1)) & (now < 4 ** (order + 2))
        parent, n = np.unique(now[here] >> 2, return_counts=True)
        full = parent[n == 4]
        now = np.unique(np.concatenate([now[~(here & np.isin(now >> 2, full))], full]))
    return now
