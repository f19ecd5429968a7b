"""Posterior samples, event databases and documents, and the plain-text sinks."""

from __future__ import annotations

import contextlib
import gzip
import io
import itertools
import re
import sqlite3
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gps import normalize_objid
from ..functions.types import fields
from ..storage import spill
from .hdf5 import read_hdf

#: Other names of sample columns.  Fixed values of the format.
ALIASES = {
    "right_ascension": "ra", "declination": "dec", "time_maxl": "time", "tc": "time", "dist": "distance", "luminosity_distance": "distance",
    "m1": "mass1", "m2": "mass2", "mass_1": "mass1", "mass_2": "mass2", "theta_jn": "inclination", "iota": "inclination", "psi": "polarization",
    "phi_orb": "phase", "geocent_time": "time",
}


def rename_aliases(df: DataFrame) -> DataFrame:
    """Known aliases get their standard names; a log distance or a cosine is turned back."""
    out = df
    for old, new in ALIASES.items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    if "logdistance" in out.columns and "distance" not in out.columns:
        out = out.withColumn("distance", F.exp("logdistance")).drop("logdistance")
    for old, new, f in (("costheta_jn", "inclination", F.acos), ("cosiota", "inclination", F.acos), ("sindec", "dec", F.asin)):
        if old in out.columns and new not in out.columns:
            out = out.withColumn(new, f(old)).drop(old)
    return out


def read_samples(spark: SparkSession, path: str, fixed: dict | None = None, table: str | None = None) -> DataFrame:
    """A posterior chain from Parquet, from an HDF5 file (``table`` by its name or path), or from white-space or comma separated text with a header."""
    if re.search(r"\.parquet(/|$)", path):
        df = spark.read.parquet(path)
    elif re.search(r"\.(h5|hdf5?)$", path):
        df = read_hdf(spark, path, table)
    else:
        head = re.sub(r"^#\s*", "", spark.read.text(path).first()[0].strip())
        comma = "," in head
        names = [c.strip() for c in (head.split(",") if comma else head.split())]
        cells = F.split(F.trim("value"), r"\s*,\s*" if comma else r"\s+")
        lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#") & (F.regexp_replace(F.trim("value"), r"^#\s*", "") != head))
        df = lines.select(*[F.get(cells, k).try_cast("double").alias(n) for k, n in enumerate(names)])
    for name, value in (fixed or {}).items():
        df = df.withColumn(name, F.lit(value))
    return rename_aliases(df)


def write_samples(df: DataFrame, path: str) -> dict:
    """Write a chain; columns of one value are left out and returned as fixed ones."""
    n = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns], *[F.first(c).alias(f"_{c}") for c in df.columns]).first()
    fixed = {c: n[f"_{c}"] for c in df.columns if n[c] == 1}
    df.drop(*fixed).write.mode("overwrite").parquet(path)
    return fixed


def kind_of_events(head: bytes) -> str:
    """Format of an event file by its first bytes: hdf, sqlite, xml, or gzip."""
    if head.startswith(b"\x89HDF\r\n\x1a\n"):
        return "hdf"
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite"
    if head.startswith(b"\x1f\x8b"):
        return "gzip"
    if head.lstrip().startswith(b"<?xml") or head.lstrip().startswith(b"<"):
        return "xml"
    raise ValueError("unknown format of events")


#: A cell of a stream with the comma behind it.
_CELL = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[^,"]*)\s*,', re.S)


def _whole_cells(text: str) -> int:
    """Length of the longest start of ``text`` that ends behind a comma outside of quotes; ``text`` begins outside."""
    cut = text.rfind(",") + 1
    while cut:
        head = text[:cut]
        if (re.sub(r"\\.", "", head, flags=re.S) if "\\" in head else head).count('"') % 2 == 0:
            return cut
        cut = text.rfind(",", 0, text.rfind('"', 0, cut)) + 1
    return 0


def ligolw_cells(stream, rows: int = 20_000):
    """Yield (table, columns as pairs of name and type, cells as they stand in the text, row after row) of a document, some ``rows`` at a time.

    ``stream`` is a binary file, which is read a piece at a time; no table is held whole.  A table without rows comes once, without cells.
    """
    from xml.parsers import expat

    ready, depth, table, inside, seen, columns, text, size, cells, many = [], 0, None, False, False, [], [], 0, [], 1 << 20

    def start(tag, own):
        nonlocal depth, table, columns, inside, seen, text, size, cells
        if tag == "Table":
            table = re.sub(r"^.*?(\w+)(:table)?$", r"\1", own.get("Name", "").replace(":table", ""))
            columns, depth, seen, cells = [], 0, False, []
            ready.append((table, columns, []))
        elif table is not None:
            depth += 1
            if tag == "Column":
                columns.append((own.get("Name", "").split(":")[-1], own.get("Type", "")))
            elif tag == "Stream" and depth == 1 and not seen:
                inside, seen, text, size = True, True, [], 0

    def take(last=False):
        nonlocal text, size, cells, many
        whole, width = "".join(text), max(1, len(columns))
        cut = len(whole) if last else _whole_cells(whole)
        # the last cell gets a comma; what is empty behind the last comma is none
        cells += _CELL.findall(whole[:cut] + "," if last and whole.strip() and not whole.rstrip().endswith(",") else whole[:cut])
        text, size = [whole[cut:]], len(whole) - cut
        many = max(1 << 20, 2 * size)
        if last:
            cells += [""] * (-len(cells) % width)
        for i in range(0, len(cells) // width * width, rows * width):
            ready.append((table, columns, cells[i : min(i + rows * width, len(cells) // width * width)]))
        cells = cells[len(cells) // width * width :]

    def data(piece):
        nonlocal size
        if inside:
            text.append(piece)
            size += len(piece)
            if size > many:
                take()

    def end(tag):
        nonlocal depth, table, inside
        if inside and tag == "Stream" and depth == 1:
            take(last=True)
            inside = False
        if tag == "Table":
            table = None
        elif table is not None:
            depth -= 1

    parser = expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, 1 << 16
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, data, end
    while piece := stream.read(1 << 18):
        parser.Parse(piece, False)
        while len(ready) > 1:  # the last one may lack columns yet
            yield ready.pop(0)
    parser.Parse(b"", True)
    yield from ready


def _typed(text: str, kind: str):
    """A cell of a document as its type says; null where it is empty."""
    text = text.strip()
    if text == "":
        return None
    text = re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S) if text.startswith('"') else text
    if kind in ("ilwd:char",):
        m = re.match(r"^\w+:\w+:(\d+)$", text)
        return int(m[1]) if m else text
    return int(text) if kind.startswith("int") else float(text) if kind.startswith("real") else text


def _opened(content: bytes):
    """A document's bytes as a file; gzip is opened as it is read."""
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def read_ligolw(document: bytes) -> dict[str, tuple[list[str], list[list]]]:
    """Tables of a LIGO Light-Weight document: name -> (columns, rows); identifiers lose their prefix."""
    out: dict = {}
    for name, columns, cells in ligolw_cells(_opened(document)):
        width = max(1, len(columns))
        rows = [[_typed(t, columns[k][1]) for k, t in enumerate(cells[i : i + width])] for i in range(0, len(cells), width)] if columns else []
        out.setdefault(name, ([c for c, _ in columns], []))[1].extend(rows)
    return out


def sqlite_batches(content: bytes, rows: int = 20_000):
    """Yield (table, columns, some rows) of an SQLite database given as bytes, opened in memory; a table without rows comes once."""
    if content[18:20] == b"\x02\x02":  # written with a write-ahead log, which bytes don't have
        content = content[:18] + b"\x01\x01" + content[20:]
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        for n in names:
            found = db.execute(f'SELECT * FROM "{n}"')
            columns = [c[0] for c in found.description]
            yield n, columns, found.fetchmany(rows)
            while some := found.fetchmany(rows):
                yield n, columns, some
    finally:
        db.close()


def read_sqlite(content: bytes) -> dict[str, tuple[list[str], list[list]]]:
    """Tables of an SQLite database given as bytes: name -> (columns, rows)."""
    out: dict = {}
    for name, columns, rows in sqlite_batches(content):
        out.setdefault(name, (columns, []))[1].extend(map(list, rows))
    return out


def open_sqlite(name: str, mode: str = "r") -> sqlite3.Connection:
    """A connection: r needs an existing file, w starts anew, a keeps what is there; pipes are refused."""
    if name in ("-", "/dev/stdin", "/dev/stdout"):
        raise ValueError("an SQLite database can't be read from or written to a pipe")
    if mode == "r":
        return sqlite3.connect(f"file:{name}?mode=ro", uri=True)
    if mode not in ("w", "a"):
        raise ValueError("the mode is r, w or a")
    if mode == "w":
        open(name, "wb").close()
    return sqlite3.connect(name)


#: Columns of the tables of events that are read.  Fixed values of the format.
EVENT_TABLES = {
    "coinc_event": "coinc_event_id:long,coinc_def_id:long,process_id:long,time_slide_id:long",
    "coinc_event_map": "coinc_event_id:long,table_name:string,event_id:long",
    "coinc_definer": "coinc_def_id:long,search:string,search_coinc_type:int",
    "coinc_inspiral": "coinc_event_id:long,combined_far:double,snr:double",
    "sngl_inspiral": "event_id:long,process_id:long,ifo:string,snr:double,coa_phase:double,end:double,mass1:double,mass2:double,spin1x:double,spin1y:double,spin1z:double,spin2x:double,spin2y:double,spin2z:double,f_final:double",
    "sim_inspiral": "simulation_id:long,longitude:double,latitude:double,distance:double",
    "process": "process_id:long,program:string",
    "process_params": "process_id:long,param:string,value:string",
    "time_slide": "time_slide_id:long,instrument:string,offset:double",
}


def event_batches(content: bytes, tables: dict[str, list[tuple[str, str]]]):
    """Yield (table, columns, a list of values for each column, types or None) of a document or database, some rows at a time; other tables are left out.

    The format is what the first bytes show; gzip is opened as it is read.  Types are those of a document whose cells are still text.
    """
    file = _opened(content)
    form = kind_of_events(file.read(64))
    file.seek(0)
    if form == "hdf":
        raise NotImplementedError("HDF files hold columns, not documents: read their groups with read_hdf and give them to hdf_events")
    if form == "sqlite":
        for name, columns, rows in sqlite_batches(file.read()):
            if name in tables and rows:
                yield name, columns, list(zip(*rows)), None
        return
    for name, columns, cells in ligolw_cells(file):
        if name in tables and cells and columns:
            yield name, [c for c, _ in columns], [cells[k :: len(columns)] for k in range(len(columns))], [t for _, t in columns]


def _column(values, kind: str, declared: str | None) -> pa.Array:
    """Values of a column as an array of ``kind``; ``declared`` is the type in a document, whose cells are text."""
    to = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[kind]
    if declared is None:
        return pa.array([_cell(v, kind) for v in values], to)
    if kind != "string" or not re.match("int|real|ilwd", declared):
        text = pc.utf8_trim_whitespace(pa.array(values, pa.string()))
        text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
        if pc.any(pc.starts_with(text, '"')).as_py():
            text = None if pc.any(pc.match_substring(text, "\\")).as_py() else pc.replace_substring_regex(text, r'(?s)^"(.*)"$', r"\1")
        try:
            if text is not None:
                return text if kind == "string" else text.cast(to)
        except pa.ArrowInvalid:
            pass  # identifiers with a prefix, and what only Python reads
    return pa.array([_cell(_typed(v, declared), kind) for v in values], to)


def _cell(value, kind: str):
    """A value of a document as that of its column: identifiers lose their prefix, times are joined from seconds and nanoseconds."""
    if value is None or (value == "" and kind != "string"):
        return None
    if kind in ("long", "int"):
        m = re.match(r"^(?:\w+:\w+:)?(-?\d+)$", str(value))
        return int(m[1]) if m else int(value)
    return float(value) if kind == "double" else str(value)


def event_table(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """(path, columns) of one table from all event files under ``path`` (a file, folder or glob), read where the files are dealt.

    Every file has rows of its own path; a file without the table, and a table without rows, add none, and the columns
    are the same always: those of ``EVENT_TABLES`` or of ``schema`` (``a:long,b:string``).  A column that a file lacks is null; ``end`` is
    joined from end_time and end_time_ns where it is kept so.
    """
    columns = [tuple(c.split(":")) for c in (schema or EVENT_TABLES[name]).split(",")]
    return _parsed(spark, path, {name: columns}).drop("table")


def _parsed(spark: SparkSession, path: str, tables: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(path, table, columns of all tables) of the files under ``path``: each file is read and parsed once, for all tables, some rows at a time."""
    every = dict(c for columns in tables.values() for c in columns)
    out = fields("path:string,table:string," + ",".join(":".join(c) for c in every.items()))

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path"), b.column("content")):
                for name, names, values, declared in event_batches(content.as_py(), tables):
                    at, n = {c: k for k, c in enumerate(names)}, len(values[0])
                    read = lambda c, t: _column(values[at[c]], t, declared and declared[at[c]])  # noqa: B023, E731
                    row = {c: read(c, t) for c, t in tables[name] if c in at}
                    if "end" not in at and "end_time" in at and ("end", "double") in tables[name]:
                        ns = pc.fill_null(read("end_time_ns", "double"), 0.0) if "end_time_ns" in at else 0.0
                        row["end"] = pc.add(read("end_time", "double"), pc.multiply(ns, 1e-9))
                    held = [row[c] if c in row else pa.nulls(n, types[t]) for c, t in every.items()]
                    yield pa.RecordBatch.from_arrays([pa.repeat(file.as_py(), n), pa.repeat(name, n), *held], names=out.names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, out)


def event_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All known tables of the event files under ``path``, by name; see ``event_table``.  One pass over the files, written once to the shared folder."""
    tables = {name: [tuple(c.split(":")) for c in columns.split(",")] for name, columns in EVENT_TABLES.items()}
    held = spill(_parsed(spark, path, tables))
    return {name: held.where(F.col("table") == name).select("path", *[c for c, _ in columns]) for name, columns in tables.items()}


def read_series(document: bytes) -> list[tuple[str, dict, list[list[float]]]]:
    """(kind, parameters, rows of numbers) of the frequency and time series of a document, in order."""
    if document[:2] == b"\x1f\x8b":
        document = gzip.decompress(document)
    out = []
    for element in ET.parse(io.BytesIO(document)).getroot().iter("LIGO_LW"):
        array = element.find("Array")
        if array is None or array.find("Stream") is None:
            continue
        width = 1
        for d in array.findall("Dim")[1:]:  # the first is the length of the series
            width *= int(d.text)
        params = {re.sub(r":param$", "", p.get("Name", "")).split(":")[-1]: (p.text or "").strip() for p in element.findall("Param")}
        for t in element.findall("Time"):
            params[t.get("Name", "")] = (t.text or "").strip()
        for d in array.findall("Dim"):
            if d.get("Scale"):
                params["scale"], params["start"] = d.get("Scale"), d.get("Start", "0")
        stream = array.find("Stream")
        cells = [float(x) for x in re.split(r"[\s,]+", (stream.text or "").strip(stream.get("Delimiter", " ") + " \n\t")) if x]
        out.append((element.get("Name", ""), params, [cells[i : i + width] for i in range(0, len(cells), width)]))
    return out


def psd_series(spark: SparkSession, path: str) -> DataFrame:
    """(path, ifo, f0, df, data) of the noise spectra in all documents under ``path``."""

    def pick(kind, params, rows):
        if not kind.endswith("FrequencySeries") or "instrument" not in params:
            return None
        df = float(params.get("scale") or (rows[1][0] - rows[0][0] if len(rows) > 1 else 1.0))
        return params["instrument"], float(params.get("f0") or rows[0][0]), df, [r[-1] for r in rows]

    return _series(spark, path, "ifo:string,f0:double,df:double,data:array<double>", pick)


def snr_series(spark: SparkSession, path: str) -> DataFrame:
    """(path, event_id, epoch, rate, snr_re, snr_im) of the SNR series in all documents under ``path``."""

    def pick(kind, params, rows):
        if not kind.endswith("TimeSeries") or "event_id" not in params:
            return None
        dt = float(params.get("scale") or (rows[1][0] - rows[0][0] if len(rows) > 1 else 1.0))
        return _cell(params["event_id"], "long"), float(params.get("epoch") or 0.0) + float(params.get("start") or rows[0][0]), 1 / dt, [r[-2] for r in rows], [r[-1] for r in rows]

    return _series(spark, path, "event_id:long,epoch:double,rate:double,snr_re:array<double>,snr_im:array<double>", pick)


def _series(spark: SparkSession, path: str, columns: str, pick) -> DataFrame:
    out = fields("path:string," + columns)

    def run(batches):
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                rows = [(file, *got) for series in read_series(bytes(content)) if (got := pick(*series)) is not None]
                if rows:
                    yield pd.DataFrame(rows, columns=out.names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, out)


_XML_TYPES = {"long": "int_8s", "int": "int_4s", "double": "real_8", "float": "real_4", "string": "lstring"}


def _head_of(name: str, columns: str) -> str:
    """A table of a document up to its rows; ``columns`` as ``a:long,b:string``."""
    named = [c.split(":") for c in columns.split(",")]
    return f'<Table Name="{name}:table">\n' + "".join(f'<Column Name="{n}" Type="{_XML_TYPES[t]}"/>\n' for n, t in named) + f'<Stream Name="{name}:table" Type="Local" Delimiter=",">\n'


_FIRST, _END_OF_TABLE, _LAST = "<?xml version='1.0' encoding='utf-8'?>\n<LIGO_LW>\n", "\n</Stream></Table>\n", "</LIGO_LW>\n"


def ligolw_document(tables: dict[str, tuple[str, list[list]]]) -> bytes:
    """A document of tables: name -> (columns as ``a:long,b:string``, rows)."""
    parts = [_FIRST]
    for name, (columns, rows) in tables.items():
        types = [c.split(":")[1] for c in columns.split(",")]

        def text(v, t):
            if v is None:
                return ""
            if t == "string":
                quoted = str(v).replace("\\", "\\\\").replace('"', '\\"')
                return escape(f'"{quoted}"')
            return str(int(v)) if t in ("long", "int") else repr(float(v))

        lines = [",".join(text(v, t) for v, t in zip(r, types)) for r in rows]
        parts += [_head_of(name, columns), ",\n".join(lines), _END_OF_TABLE]
    return "".join([*parts, _LAST]).encode()


def _line(columns: str) -> Column:
    """A row as it stands in a document."""

    def text(c, t):
        if t != "string":
            return F.col(c).cast("double" if t == "float" else t).cast("string")
        for old, new in (("\\", "\\\\"), ('"', '\\"'), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(F.col(c) if isinstance(c, str) else c, F.lit(old), F.lit(new))
        return F.concat(F.lit('"'), c, F.lit('"'))

    return F.concat_ws(",", *[F.coalesce(text(*c.split(":")), F.lit("")) for c in columns.split(",")])


def write_ligolw(tables: dict[str, DataFrame], key: str, folder: str, suffix: str = ".xml.gz") -> DataFrame:
    """One document for each value of ``key``, written by the task that holds it: (key, path, bytes), once an action runs.

    Every table has ``key``; its other columns are plain ones of ``EVENT_TABLES``' kinds.  Rows of all tables go to their document
    together, sorted by Spark, and are written as they come: no document is held whole.  .gz is compressed.
    """
    from .fits import saved

    kinds = {n: ",".join(f"{f.name}:{ {'bigint': 'long'}.get(f.dataType.simpleString(), f.dataType.simpleString())}" for f in t.schema.fields if f.name != key) for n, t in tables.items()}
    both = None
    for k, (n, t) in enumerate(tables.items()):
        own = t.select(F.col(key).cast("string").alias("key"), F.lit(k).alias("table"), _line(kinds[n]).alias("line"))
        both = own if both is None else both.unionByName(own)
    between = [(_END_OF_TABLE if k else _FIRST) + _head_of(n, columns) for k, (n, columns) in enumerate(kinds.items())]
    end = (_END_OF_TABLE if kinds else _FIRST) + _LAST

    def runs(batches):
        """(key, table, lines): stretches of rows of one table of one document."""
        for b in batches:
            keys, places, lines = (b.column(c) for c in ("key", "table", "line"))
            first = 0
            while first < b.num_rows:
                same = pc.and_kleene(pc.equal(places, places[first]), pc.equal(keys, keys[first]) if keys[first].is_valid else pc.is_null(keys))
                last = first + pc.sum(same.slice(first)).as_py()  # rows are sorted
                yield keys[first].as_py(), places[first].as_py(), lines.slice(first, last - first).to_pylist()
                first = last

    def write(batches):
        for k, own in itertools.groupby(runs(batches), key=lambda r: r[0]):
            path, size = f"{folder}/{k}{suffix}", 0
            with saved(path) as file, gzip.GzipFile("", "wb", 6, file, 0) if suffix.endswith(".gz") else contextlib.nullcontext(file) as out:
                done, fresh = 0, True
                for _, place, lines in own:
                    while done <= place:
                        out.write(between[done].encode())
                        done, fresh = done + 1, True
                    out.write((("" if fresh else ",\n") + ",\n".join(lines)).encode())
                    fresh = False
                out.write(("".join(between[done:]) + end).encode())
                if out is not file:
                    out.close()
                size = file.tell()
            yield pa.RecordBatch.from_pydict({"key": [k], "path": [path], "bytes": [size]}, schema=pa.schema([("key", pa.string()), ("path", pa.string()), ("bytes", pa.int64())]))

    return both.repartition("key").sortWithinPartitions("key", "table", "line").mapInArrow(write, fields("key:string,path:string,bytes:long"))


def find_table(spark: SparkSession, folder: str, name: str = "posterior_samples") -> str:
    """The one Parquet table of this name at any depth below ``folder``; an error if there is none or several."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, waiting = [], [root]
    while waiting:
        for status in system.listStatus(waiting.pop()):
            own = status.getPath()
            if own.getName() in (name, f"{name}.parquet"):
                found.append(own.toString())
            elif status.isDirectory():
                waiting.append(own)
    if len(found) != 1:
        raise ValueError(f"{len(found)} tables of the name {name} below {folder}: {', '.join(sorted(found)) or 'none'}")
    return found[0]


def kind_of_hdf(df_columns: list[str], attributes: dict) -> str:
    """Which of the files of a search a table of the HDF layout stands for: coincs, psds, triggers or bank."""
    columns = set(df_columns)
    if {"trigger_ids", "template_id"} <= columns or attributes.get("kind") == "foreground":
        return "coincs"
    if {"start", "end"} <= columns and ("data" in columns or "segment" in columns):
        return "psds"
    if {"snr", "coa_phase", "end_time"} <= columns:
        return "triggers"
    if {"mass1", "mass2"} <= columns:
        return "bank"
    raise ValueError("a table of the HDF layout that is none of coincs, psds, triggers, bank")


def hdf_tables(tables: list[DataFrame]) -> dict[str, DataFrame | list[DataFrame]]:
    """Tables of the HDF layout by what they are: exactly one of coincs and one bank, any number of the others."""
    out: dict = {"coincs": [], "psds": [], "triggers": [], "bank": []}
    for t in tables:
        out[kind_of_hdf(t.columns, {})].append(t)
    for one in ("coincs", "bank"):
        if len(out[one]) != 1:
            raise ValueError(f"expected exactly one table of {one}, not {len(out[one])}")
        out[one] = out[one][0]
    return out


class EventSource:
    """A mapping from an identifier to its event, over DataFrames: ``rows`` has one row for each event.

    ``source["12"]`` and iteration are for looking around; work on many events goes through ``rows``.
    """

    def __init__(self, rows: DataFrame, key: str = "coinc_event_id"):
        self.rows, self.key = rows, key

    def __getitem__(self, identifier):
        found = self.rows.where(F.col(self.key).cast("string") == str(identifier)).take(2)
        if len(found) != 1:
            raise KeyError(identifier)
        return found[0]

    def __len__(self) -> int:
        return self.rows.count()

    def __iter__(self):
        return (r[0] for r in self.rows.select(self.key).orderBy(self.key).toLocalIterator())

    def items(self):
        return ((r[self.key], r) for r in self.rows.orderBy(self.key).toLocalIterator())


def open_events(spark: SparkSession, path: str, search: tuple[str, int] | None = ("inspiral", 0), **options) -> EventSource:
    """The events of all documents and databases under ``path``, whatever their format: tables read, filtered and assembled.

    ``search``: (search, search_coinc_type) of the coincidences wanted, None for all.  Identifiers hold within their file, so rows have its
    path beside coinc_event_id.  ``options`` go to ``assemble``.
    """
    from ..operators import events

    t = event_tables(spark, path)
    coincs = t["coinc_event"] if search is None else events.of_definition(t["coinc_event"], t["coinc_definer"], *search, by=["path"])
    psds = t["process_params"].where("param = '--reference-psd'")
    return EventSource(events.assemble(coincs, t["coinc_event_map"], t["sngl_inspiral"], t["process"], t["time_slide"], None, psds, by=["path"], **options))


def follow_alerts(spark: SparkSession, folder: str, glob: str = "*.xml*") -> DataFrame:
    """Alerts as documents that arrive in a folder, as a stream of (graceid, path, content).

    A service's client puts each alert's document there under its identifier; the name up to the first dot is the identifier.
    """
    found = read_directory(spark, folder, glob)
    return found.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("graceid"), "path", "content")


def with_ids(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, normalize_objid(c))
    return df


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, column: str = "json") -> None:
    df.select(column).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines that aren't blank, trimmed; as a stream of new files if asked."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_directory(spark: SparkSession, path: str, glob: str = "*.xml*", streaming: bool = True) -> DataFrame:
    """Event documents as they arrive in a folder: (path, content)."""
    reader = spark.readStream if streaming else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    return reader.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path).select("path", "content")
