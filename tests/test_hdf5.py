"""HDF5 containers made byte by byte after the public specification of the format, read back by the data source."""

import struct
import zlib

import numpy as np
import pytest

from skylattice.sources import hdf5, tables


def kind(dtype):
    """A datatype message."""
    dtype = np.dtype(dtype)
    if dtype.names:
        body = b""
        for n in dtype.names:
            t, offset = dtype.fields[n][:2]
            name = n.encode() + b"\0"
            body += name + b"\0" * (-len(name) % 8) + struct.pack("<IB3xI4x4I", offset, 0, 0, 0, 0, 0, 0) + kind(t)
        return struct.pack("<BBHI", 0x16, len(dtype.names), 0, dtype.itemsize) + body
    if dtype.kind == "S":
        return struct.pack("<B3xI", 0x13, dtype.itemsize)
    if dtype.kind == "b":
        base = struct.pack("<BB2xIHH", 0x10, 8, 1, 0, 8)
        return struct.pack("<BBHI", 0x18, 2, 0, 1) + base + b"FALSE\0\0\0TRUE\0\0\0\0" + b"\0\1"
    big = dtype.byteorder == ">"
    if dtype.kind in "iu":
        return struct.pack("<BB2xIHH", 0x10, (8 if dtype.kind == "i" else 0) | big, dtype.itemsize, 0, 8 * dtype.itemsize)
    sizes = {4: (23, 8, 23, 127), 8: (52, 11, 52, 1023)}[dtype.itemsize]
    return struct.pack("<BBB1xIHHBBBBI", 0x11, 0x20 | big, 8 * dtype.itemsize - 1, dtype.itemsize, 0, 8 * dtype.itemsize, sizes[0], sizes[1], 0, sizes[2], sizes[3])


class Builder:
    """A file of groups (dicts) and datasets (arrays, or arrays with options)."""

    def __init__(self, new=False):
        self.data, self.new = bytearray(2048), new

    def put(self, content: bytes) -> int:
        at = len(self.data)
        self.data += content + b"\0" * (-len(content) % 8)
        return at

    def header(self, messages, split=False) -> int:
        if self.new:
            body = b"".join(struct.pack("<BHB", k, len(c), 0) + c for k, c in messages)
            return self.put(b"OHDR\x02\x02" + struct.pack("<I", len(body)) + body + b"\0\0\0\0")
        messages = [(k, c + b"\0" * (-len(c) % 8)) for k, c in messages]
        pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(c), 0) + c for k, c in ms)
        if split:  # the rest in a continuation
            rest = pack(messages[1:])
            messages = [messages[0], (hdf5.CONTINUED, struct.pack("<QQ", self.put(rest), len(rest)))]
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(pack(messages))) + pack(messages))

    def node(self, thing) -> int:
        if isinstance(thing, dict):
            inner = {n: self.node(v) for n, v in sorted(thing.items())}
            if self.new:
                return self.header([(hdf5.LINK, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", a)) for n, a in inner.items()])
            heap, places = bytearray(8), {}
            for n in inner:
                places[n] = len(heap)
                heap += n.encode() + b"\0" * (8 - len(n) % 8)
            names = list(inner)
            leaves = [names[k : k + 2] for k in range(0, len(names), 2)] or [[]]
            nodes = [self.put(b"SNOD\1\0" + struct.pack("<H", len(part)) + b"".join(struct.pack("<QQII16x", places[n], inner[n], 0, 0) for n in part)) for part in leaves]
            tree = b"TREE\0\0" + struct.pack("<HQQ", len(nodes), hdf5.NOWHERE, hdf5.NOWHERE) + struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", a, places[part[-1]] if part else 0) for a, part in zip(nodes, leaves))
            where = self.put(bytes(heap))
            heap_at = self.put(b"HEAP\0\0\0\0" + struct.pack("<QQQ", len(heap), hdf5.NOWHERE, where))
            return self.header([(hdf5.SYMBOLS, struct.pack("<QQ", self.put(tree), heap_at))])
        array, options = thing if isinstance(thing, tuple) else (thing, {})
        array = np.asarray(array)
        space = (struct.pack("<BBBB", 2, array.ndim, 0, 1) if self.new else struct.pack("<BBB5x", 1, array.ndim, 0)) + struct.pack(f"<{array.ndim}Q", *array.shape)
        messages = [(hdf5.SPACE, space), (hdf5.TYPE, kind(array.dtype))]
        chunk = options.get("chunk")
        if options.get("compact"):
            messages.append((hdf5.LAYOUT, struct.pack("<BBH", 3, 0, array.nbytes) + array.tobytes()))
        elif chunk is None:
            messages.append((hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, self.put(array.tobytes()) if array.size else hdf5.NOWHERE, array.nbytes)))
        else:
            filters = options.get("filters", [])
            if filters:
                messages.append((hdf5.FILTERS, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", f, 8, 0, 1) + b"a name\0\0" + struct.pack("<II", 1, 0) for f in filters)))
            keys = []
            for offset in np.ndindex(*[-(-s // c) for s, c in zip(array.shape, chunk)]):
                offset = tuple(o * c for o, c in zip(offset, chunk))
                whole = np.zeros(chunk, array.dtype)
                part = array[tuple(slice(o, o + c) for o, c in zip(offset, chunk))]
                whole[tuple(slice(0, n) for n in part.shape)] = part
                raw = whole.tobytes()
                for f in filters:
                    raw = {hdf5.SHUFFLE: lambda r: np.frombuffer(r, np.uint8).reshape(-1, array.itemsize).T.tobytes(), hdf5.DEFLATE: zlib.compress, hdf5.FLETCHER: lambda r: r + b"sum!"}[f](raw)
                keys.append((len(raw), offset, self.put(raw)))
            key = lambda size, offset: struct.pack(f"<II{array.ndim + 1}Q", size, 0, *offset, 0)
            end = key(0, (-(-array.shape[0] // chunk[0]) * chunk[0], *[0] * (array.ndim - 1)))
            leaf = lambda part, then: self.put(b"TREE\1\0" + struct.pack("<HQQ", len(part), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(key(s, o) + struct.pack("<Q", a) for s, o, a in part) + then)
            parts = [keys[k : k + 3] for k in range(0, len(keys), 3)]
            nodes = [(p, leaf(p, key(*parts[k + 1][0][:2]) if k + 1 < len(parts) else end)) for k, p in enumerate(parts)]
            top = nodes[0][1] if len(nodes) == 1 else self.put(b"TREE\1\1" + struct.pack("<HQQ", len(nodes), hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(key(*p[0][:2]) + struct.pack("<Q", a) for p, a in nodes) + end)
            messages.append((hdf5.LAYOUT, struct.pack(f"<BBBQ{array.ndim + 1}I", 3, 2, array.ndim + 1, top, *chunk, array.itemsize)))
        return self.header(messages, options.get("split", False))

    def bytes(self, root: dict) -> bytes:
        at = self.node(root)
        if self.new:
            head = hdf5.SIGNATURE + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, hdf5.NOWHERE, len(self.data), at)
        else:
            head = hdf5.SIGNATURE + struct.pack("<BBBBBBBBHHIQQQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, hdf5.NOWHERE, len(self.data), hdf5.NOWHERE, 0, at)
        self.data[: len(head)] = head
        return bytes(self.data)


SAMPLES = np.zeros(1000, np.dtype([("ra", "<f8"), ("dec", ">f4"), ("n", "<i2"), ("found", "?"), ("name", "S5")]))
SAMPLES["ra"], SAMPLES["dec"], SAMPLES["n"] = np.linspace(0, 6, 1000), np.linspace(-1, 1, 1000), np.arange(1000) - 500
SAMPLES["found"], SAMPLES["name"] = np.arange(1000) % 3 == 0, [f"s{k % 9}".encode() for k in range(1000)]


def write(path, root, **how):
    path.write_bytes(Builder(**how).bytes(root))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.orderBy("n").collect()]


def plain():
    return [(float(r["ra"]), float(r["dec"]), int(r["n"]), bool(r["found"]), r["name"].decode()) for r in SAMPLES]


@pytest.mark.parametrize("how", [{}, {"chunk": (64,)}, {"chunk": (128,), "filters": [hdf5.SHUFFLE, hdf5.DEFLATE]}, {"chunk": (300,), "filters": [hdf5.DEFLATE, hdf5.FLETCHER]}, {"compact": True}, {"split": True}])
@pytest.mark.parametrize("new", [False, True])
def test_samples_come_back(spark, tmp_path, how, new):
    path = write(tmp_path / "a.hdf5", {"other": np.arange(3), "lalinference": {"run": {"posterior_samples": (SAMPLES, how)}}}, new=new)
    df = hdf5.read_hdf(spark, path, "posterior_samples", rowsPerPartition="100")
    assert [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema] == ["ra:double", "dec:double", "n:bigint", "found:boolean", "name:string"]
    assert df.rdd.getNumPartitions() == (-(-1000 // (-(-100 // how["chunk"][0]) * how["chunk"][0])) if "chunk" in how else 10)
    assert rows(df) == plain()


def test_groups_of_datasets_and_many_files(spark, tmp_path):
    for k in range(2):
        write(tmp_path / f"{k}.hdf", {"H1": {"snr": np.arange(50) + 100.0 * k, "row": (np.arange(50) + 50 * k, {"chunk": (7,)}), "psi": (np.arange(150).reshape(50, 3) + k, {"chunk": (9, 2), "filters": [hdf5.DEFLATE]})}})
    df = hdf5.read_hdf(spark, str(tmp_path / "*.hdf"), group="H1", rowsPerPartition=20)
    got = {r.row: r for r in df.collect()}
    assert len(got) == 100 and all(r.snr == k % 50 + 100.0 * (k // 50) and list(r.psi) == [3 * (k % 50) + j + k // 50 for j in range(3)] for k, r in got.items())


def test_tables_are_found_by_name(spark, tmp_path):
    path = write(tmp_path / "a.hdf5", {"foo": {"bar": SAMPLES, "bat": SAMPLES, "xyzzy": {"bat": SAMPLES}}})
    with open(path, "rb") as f:
        c = hdf5.Container(f)
        assert c.find("bar") == "foo/bar" and c.find("foo/bat") == "foo/bat"
        with pytest.raises(KeyError, match="no table plugh"):
            c.find("plugh")
        with pytest.raises(KeyError, match="several tables bat in the file: foo/bat, foo/xyzzy/bat"):
            c.find("bat")
    assert tables.kind_of_events(open(path, "rb").read(64)) == "hdf"
    assert tables.read_samples(spark, path, table="foo/xyzzy/bat").count() == 1000


def test_only_the_chunks_of_the_rows_are_read(tmp_path):
    path = write(tmp_path / "a.hdf5", {"t": (np.arange(10_000), {"chunk": (100,), "filters": [hdf5.SHUFFLE, hdf5.DEFLATE]})})
    with open(path, "rb") as f:
        c = hdf5.Container(f)
        data = c.dataset("t")
        assert len(list(c._chunks(data, 250, 350))) == 2
        assert c.rows(data, 250, 350).tolist() == list(range(250, 350)) and c.rows(data, 9_990, 10_000)[-1] == 9_999


def test_empty_and_damaged_files(spark, tmp_path):
    path = write(tmp_path / "a.hdf5", {"t": np.zeros(0, np.dtype([("x", "<f8")]))})
    assert hdf5.read_hdf(spark, path).collect() == []
    (tmp_path / "b.hdf5").write_bytes(open(path, "rb").read()[:1000])
    with open(tmp_path / "b.hdf5", "rb") as f, pytest.raises(ValueError, match="ends early"):
        hdf5.Container(f).datasets()
    (tmp_path / "c.hdf5").write_bytes(b"something else" * 20)
    with open(tmp_path / "c.hdf5", "rb") as f, pytest.raises(ValueError, match="not an HDF5 file"):
        hdf5.Container(f)
