"""Tables in HDF5 containers: a reader of the public file format and a Spark data source over it.

Read are superblocks 0 to 3, object headers 1 and 2, groups by symbol tables and by compact links, compact, contiguous and chunked datasets (chunks by a B-tree of version 1),
the filters deflate, shuffle and Fletcher-32, and numbers, fixed strings, enumerations and compounds of them.  What a file has beyond these
raises ``NotImplementedError``.  Only the bytes that are asked for are read: a partition is a range of rows, and reads the chunks that it touches.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fits import file_system, list_files

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Kinds of header messages and numbers of filters.  Fixed values of the format.
SPACE, LINK_INFO, TYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3


class _Bytes:
    """Little-endian numbers taken from bytes in turn."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def raw(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("the HDF5 file ends early")
        self.at += n
        return out

    def number(self, n: int) -> int:
        return int.from_bytes(self.raw(n), "little")

    def numbers(self, n: int, count: int) -> list[int]:
        return [self.number(n) for _ in range(count)]

    def text(self, multiple: int = 1) -> str:
        """Up to a zero; with it a multiple of so many bytes."""
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at += -(-(end + 1 - self.at) // multiple) * multiple
        return out


def _type(b: _Bytes) -> np.dtype:
    """The next datatype; enumerations are those of their base, those of false and true are booleans."""
    head, bits, size = b.number(1), b.number(3), b.number(4)
    version, kind = head >> 4, head & 15
    if kind == 0:
        b.raw(4)
        return np.dtype(f"{'>' if bits & 1 else '<'}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        b.raw(12)
        return np.dtype(f"{'>' if bits & 1 else '<'}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    if kind == 6:
        names, formats, offsets = [], [], []
        for _ in range(bits & 0xFFFF):
            names.append(b.text(8 if version < 3 else 1))
            offsets.append(b.number(4 if version < 3 else max(1, (size.bit_length() + 7) // 8)))
            shape = ()
            if version == 1:
                rank = b.number(1)
                b.raw(11)
                shape = tuple(b.numbers(4, 4)[:rank])
            formats.append((_type(b), shape) if shape else _type(b))
        return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": size})
    if kind == 8:
        base = _type(b)
        names = [b.text(8 if version < 3 else 1) for _ in range(bits & 0xFFFF)]
        b.raw(base.itemsize * (bits & 0xFFFF))
        return np.dtype(bool) if [n.upper() for n in names] == ["FALSE", "TRUE"] and base.itemsize == 1 else base
    if kind == 10:
        rank = b.number(1)
        b.raw(3 if version < 3 else 0)
        shape = tuple(b.numbers(4, rank))
        if version < 3:
            b.raw(4 * rank)
        return np.dtype((_type(b), shape))
    raise NotImplementedError(f"HDF5 datatypes of class {kind}")


@dataclass
class Dataset:
    """What a header says of a dataset; ``chunk`` is the shape of a chunk, ``place`` its bytes, address or B-tree."""

    dtype: np.dtype
    shape: tuple[int, ...]
    layout: str
    place: object
    chunk: tuple[int, ...] = ()
    filters: list[int] = field(default_factory=list)


class Container:
    """An HDF5 file that can be sought in."""

    def __init__(self, file):
        self.file = file
        head = self._read(0, 128, short=True)
        if not head.startswith(SIGNATURE):
            raise ValueError("not an HDF5 file")
        b = _Bytes(head, 8)
        version = b.number(1)
        if version < 2:
            b.raw(4)
            sizes = b.numbers(1, 2)
            b.raw(1 + 8 + (4 if version else 0))
            self.base = b.number(8)
            b.raw(24 + 8)
            self.root = b.number(8)
        elif version < 4:
            sizes = b.numbers(1, 2)
            b.raw(1)
            self.base = b.number(8)
            b.raw(16)
            self.root = b.number(8)
        else:
            raise NotImplementedError(f"HDF5 superblocks of version {version}")
        if sizes != [8, 8]:
            raise NotImplementedError(f"HDF5 addresses of {sizes[0]} and lengths of {sizes[1]} bytes")

    def _read(self, at: int, n: int, short: bool = False) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) < n and not short:
            raise ValueError("the HDF5 file ends early")
        return out

    def read(self, address: int, n: int) -> bytes:
        return self._read(self.base + address, n)

    def messages(self, address: int):
        """Yield (kind, content) of an object's header."""
        head = self.read(address, 16)
        parts = []
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            wide = 1 << (flags & 3)
            size = int.from_bytes(self.read(address + at, wide), "little")
            parts.append((address + at + wide, size))
            order = 2 if flags & 4 else 0
        elif head[0] == 1:
            order = None
            parts.append((address + 16, int.from_bytes(head[8:12], "little")))
        else:
            raise NotImplementedError("this version of HDF5 object headers")
        while parts:
            at, size = parts.pop(0)
            b = _Bytes(self.read(at, size))
            least = 8 if order is None else 4 + order
            while b.at + least <= size:
                if order is None:
                    kind, n = b.number(2), b.number(2)
                    flags = b.number(1)
                    b.raw(3)
                else:
                    kind, n, flags = b.number(1), b.number(2), b.number(1)
                    b.raw(order)
                content = b.raw(n)
                if flags & 2:
                    raise NotImplementedError("shared HDF5 header messages")
                if kind == CONTINUED:
                    c = _Bytes(content)
                    there, length = c.number(8), c.number(8)
                    # a block of a new header has a signature before and a checksum behind
                    parts.append((there, length) if order is None else (there + 4, length - 8))
                else:
                    yield kind, content

    def children(self, address: int) -> dict[str, int]:
        """Names and addresses of what a group holds; empty for a dataset."""
        out = {}
        for kind, content in self.messages(address):
            b = _Bytes(content)
            if kind == SYMBOLS:
                tree, heap = b.number(8), b.number(8)
                out.update(self._symbols(tree, heap))
            elif kind == LINK:
                b.raw(1)
                flags = b.number(1)
                hard = b.number(1) if flags & 8 else 0
                b.raw((8 if flags & 4 else 0) + (1 if flags & 16 else 0))
                name = b.raw(b.number(1 << (flags & 3))).decode("utf-8", "replace")
                if hard == 0:
                    out[name] = b.number(8)
            elif kind == LINK_INFO:
                flags = content[1]
                if int.from_bytes(content[2 + (8 if flags & 1 else 0) :][:8], "little") != NOWHERE:
                    raise NotImplementedError("HDF5 groups with links in a fractal heap")
        return out

    def _symbols(self, tree: int, heap: int):
        h = _Bytes(self.read(heap, 32), 8)
        size = h.number(8)
        h.raw(8)
        names = self.read(h.number(8), size)
        todo = [tree]
        while todo:
            at = todo.pop()
            head = _Bytes(self.read(at, 24))
            if head.raw(4) == b"SNOD":
                count = int.from_bytes(self.read(at + 6, 2), "little")
                b = _Bytes(self.read(at + 8, 40 * count))
                for _ in range(count):
                    name, address = b.number(8), b.number(8)
                    b.raw(24)
                    yield _Bytes(names, name).text(), address
                continue
            head.raw(2)
            count = head.number(2)
            b = _Bytes(self.read(at + 24, 16 * count + 8))
            for _ in range(count):
                b.raw(8)
                todo.append(b.number(8))

    def datasets(self) -> dict[str, int]:
        """Addresses of all datasets by their path."""
        out, todo, seen = {}, [("", self.root)], set()
        while todo:
            path, address = todo.pop()
            if address in seen:
                continue
            seen.add(address)
            kinds = {kind for kind, _ in self.messages(address)}
            if LAYOUT in kinds:
                out[path] = address
            else:
                todo += [(f"{path}/{name}" if path else name, a) for name, a in self.children(address).items()]
        return dict(sorted(out.items()))

    def find(self, name: str) -> str:
        """The path of the one dataset of that name, or of that path."""
        every = self.datasets()
        if name.strip("/") in every:
            return name.strip("/")
        found = [p for p in every if p.rpartition("/")[2] == name]
        if not found:
            raise KeyError(f"no table {name} in the file")
        if len(found) > 1:
            raise KeyError(f"several tables {name} in the file: {', '.join(found)}")
        return found[0]

    def dataset(self, path: str) -> Dataset:
        at = self.root
        for part in path.strip("/").split("/"):
            at = self.children(at)[part]
        said = dict(self.messages(at))
        b = _Bytes(said[SPACE])
        version, rank, _ = b.number(1), b.number(1), b.number(1)
        b.raw(5 if version == 1 else 1)
        shape = tuple(b.numbers(8, rank))
        out = Dataset(_type(_Bytes(said[TYPE])), shape, "", None, filters=self._filters(said.get(FILTERS)))
        b = _Bytes(said[LAYOUT])
        version, kind = b.number(1), b.number(1)
        if version != 3:
            raise NotImplementedError(f"HDF5 layouts of version {version}")
        if kind == 0:
            out.layout, out.place = "compact", b.raw(b.number(2))
        elif kind == 1:
            out.layout, out.place = "contiguous", b.number(8)
        else:
            rank = b.number(1)
            out.layout, out.place, out.chunk = "chunked", b.number(8), tuple(b.numbers(4, rank)[:-1])
        return out

    @staticmethod
    def _filters(content: bytes | None) -> list[int]:
        if content is None:
            return []
        b = _Bytes(content)
        version, count = b.number(1), b.number(1)
        b.raw(6 if version == 1 else 0)
        out = []
        for _ in range(count):
            number = b.number(2)
            name = b.number(2) if version == 1 or number >= 256 else 0
            b.raw(2)
            values = b.number(2)
            b.raw(-(-name // 8) * 8 if version == 1 else name)
            b.raw(4 * values + (4 if version == 1 and values % 2 else 0))
            out.append(number)
        return out

    def _chunks(self, data: Dataset, first: int, last: int):
        """Yield (offsets, bytes, mask of filters left out, address) of the chunks that hold rows ``first`` to ``last``."""
        todo, rank = [data.place] if data.place != NOWHERE else [], len(data.shape)
        while todo:
            at = todo.pop()
            head = _Bytes(self.read(at, 24))
            if head.raw(4) != b"TREE" or head.number(1) != 1:
                raise ValueError("not a B-tree of chunks")
            level, count = head.number(1), head.number(2)
            wide = 8 + 8 * (rank + 1)
            b = _Bytes(self.read(at + 24, count * (wide + 8) + wide))
            keys, places = [], []
            for k in range(count + 1):
                keys.append((b.number(4), b.number(4), b.numbers(8, rank + 1)[:-1]))
                if k < count:
                    places.append(b.number(8))
            for k, place in enumerate(places):
                size, mask, offset = keys[k]
                # children are in the order of their offsets, the first of which is the row
                if level and (offset[0] >= last or keys[k + 1][2][0] + data.chunk[0] <= first):
                    continue
                if level:
                    todo.append(place)
                elif offset[0] < last and offset[0] + data.chunk[0] > first:
                    yield offset, size, mask, place

    def rows(self, data: Dataset, first: int, last: int) -> np.ndarray:
        """Rows ``first`` to ``last`` of a dataset; chunks that were never written are zero."""
        if not data.shape:
            first, last = 0, 1
        shape = data.shape or (1,)
        each = int(np.prod(shape[1:], dtype=np.int64)) * data.dtype.itemsize
        n = max(0, last - first)
        if data.layout == "compact":
            return np.frombuffer(data.place[first * each : last * each], data.dtype).reshape(n, *shape[1:])
        if data.layout == "contiguous":
            if data.place == NOWHERE or not n:
                return np.zeros((n, *shape[1:]), data.dtype)
            return np.frombuffer(self.read(data.place + first * each, n * each), data.dtype).reshape(n, *shape[1:])
        out = np.zeros((n, *shape[1:]), data.dtype)
        for offset, size, mask, place in self._chunks(data, first, last):
            raw = self.read(place, size)
            for k in range(len(data.filters) - 1, -1, -1):
                if mask >> k & 1:
                    continue
                number = data.filters[k]
                if number == DEFLATE:
                    raw = zlib.decompress(raw)
                elif number == FLETCHER:
                    raw = raw[:-4]
                elif number == SHUFFLE:
                    whole = len(raw) // data.dtype.itemsize * data.dtype.itemsize
                    raw = np.frombuffer(raw[:whole], np.uint8).reshape(data.dtype.itemsize, -1).T.tobytes() + raw[whole:]
                else:
                    raise NotImplementedError(f"the HDF5 filter {number}")
            part = np.frombuffer(raw, data.dtype, int(np.prod(data.chunk, dtype=np.int64))).reshape(data.chunk)
            into, of = [slice(max(offset[0], first) - first, min(offset[0] + data.chunk[0], last, shape[0]) - first)], [slice(max(first - offset[0], 0), min(last, shape[0]) - offset[0])]
            for o, c, s in zip(offset[1:], data.chunk[1:], shape[1:]):
                into.append(slice(o, min(o + c, s)))
                of.append(slice(0, min(c, s - o)))
            out[tuple(into)] = part[tuple(of)]
        return out


def _kind(dtype: np.dtype) -> T.DataType:
    if dtype.subdtype is not None:
        out = _kind(dtype.subdtype[0])
        for _ in dtype.subdtype[1]:
            out = T.ArrayType(out)
        return out
    if dtype.kind == "b":
        return T.BooleanType()
    if dtype.kind in "iu":
        return T.LongType()
    if dtype.kind == "f":
        return T.DoubleType()
    if dtype.kind == "S":
        return T.StringType()
    raise NotImplementedError(f"columns of type {dtype}")


def _columns(c: Container, options) -> dict[str, tuple[str, str | None]]:
    """Column: (dataset, member of its compound) of a table, or of all datasets of one length in a group."""
    if options.get("group") is not None:
        group = options["group"].strip("/")
        paths = [p for p in c.datasets() if p.rpartition("/")[0] == group and len(c.dataset(p).shape) >= 1]
        if not paths:
            raise KeyError(f"no group {group} with datasets in the file")
        if len({c.dataset(p).shape[0] for p in paths}) > 1:
            raise ValueError(f"the datasets of {group} differ in length")
        return {p.rpartition("/")[2]: (p, None) for p in paths}
    name = options.get("table")
    every = list(c.datasets())
    if name is None and len(every) != 1:
        raise KeyError(f"name one of the tables {', '.join(every)}")
    path = every[0] if name is None else c.find(name)
    dtype = c.dataset(path).dtype
    return {n: (path, n) for n in dtype.names} if dtype.names else {path.rpartition("/")[2]: (path, None)}


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class HdfReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, dict(options)
        self.each = int(self.options.get("rowsperpartition", 1 << 20))

    def partitions(self):
        out = []
        for path in list_files(self.options["path"]) or [self.options["path"]]:
            system, name = file_system(path)
            with system.open_input_file(name) as f:
                c = Container(f)
                data = c.dataset(next(iter(_columns(c, self.options).values()))[0])
            n = data.shape[0] if data.shape else 1
            step = -(-self.each // data.chunk[0]) * data.chunk[0] if data.chunk else self.each  # no chunk is read twice
            out += [_Rows(path, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, partition):
        if partition is None:
            return
        system, name = file_system(partition.path)
        with system.open_input_file(name) as f:
            c = Container(f)
            at = _columns(c, self.options)
            held = {p: c.dataset(p) for p in {p for p, _ in at.values()}}
            for k in range(partition.first, partition.last, 65_536):
                stop = min(partition.last, k + 65_536)
                rows = {p: c.rows(d, k, stop) for p, d in held.items()}
                columns = []
                for one in self.schema.fields:
                    if one.name not in at:
                        columns.append(pa.nulls(stop - k, pa.string() if one.dataType.simpleString() == "string" else pa.float64() if one.dataType.simpleString() == "double" else pa.int64()))
                        continue
                    path, member = at[one.name]
                    columns.append(_arrow(rows[path] if member is None else rows[path][member]))
                yield pa.RecordBatch.from_arrays(columns, self.schema.names)


def _arrow(x: np.ndarray) -> pa.Array:
    if x.ndim > 1:
        flat = _arrow(np.ascontiguousarray(x).reshape(-1))
        for size in x.shape[:0:-1]:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()) if size else pa.array(np.zeros(len(x) + 1), pa.int32()), flat)
        return flat
    if x.dtype.kind == "S":
        return pa.array([v.rstrip(b"\0").decode("utf-8", "replace") for v in x.tolist()], pa.string())
    if x.dtype.kind == "b":
        return pa.array(x.tolist(), pa.bool_())
    return pa.array(x.astype(np.int64 if x.dtype.kind in "iu" else np.float64))


class HdfTables(DataSource):
    """``spark.read.format("sky_hdf").option("table", "posterior_samples").load(path)``: a table of all files that ``path`` names.

    ``table`` is the name or path of a dataset, looked for in all groups; ``group`` takes the datasets of a group as columns.  Integers come as long, numbers as double.
    ``rowsPerPartition`` rows, whole chunks of them, are a partition.
    """

    @classmethod
    def name(cls):
        return "sky_hdf"

    def schema(self):
        first = (list_files(self.options["path"]) or [self.options["path"]])[0]
        system, name = file_system(first)
        with system.open_input_file(name) as f:
            c = Container(f)
            out = []
            for column, (path, member) in _columns(c, self.options).items():
                data = c.dataset(path)
                kind = _kind(data.dtype if member is None else data.dtype.fields[member][0])
                for _ in data.shape[1:]:
                    kind = T.ArrayType(kind)
                out.append(T.StructField(column, kind))
            return T.StructType(out)

    def reader(self, schema):
        return HdfReader(schema, self.options)


def read_hdf(spark: SparkSession, path: str, table: str | None = None, group: str | None = None, **options) -> DataFrame:
    """A table of HDF5 files, or the datasets of a group as columns; see ``HdfTables``."""
    spark.dataSource.register(HdfTables)
    reader = spark.read.format("sky_hdf")
    for k, v in {"table": table, "group": group, **options}.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load(path)
