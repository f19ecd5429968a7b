"""Event documents of any length: written and read as streams."""

import gzip
import io
import os
import tracemalloc

from skylattice.plans import extra
from skylattice.sources import tables


def test_reading_holds_no_table_whole(spark, tmp_path):
    n = 150_000
    rows = ",\n".join(f'"sngl_inspiral:event_id:{k}",{k % 7},"H1",{k * 0.5!r}' for k in range(n))
    columns = "".join(f'<Column Name="{c}" Type="{t}"/>' for c, t in (("event_id", "ilwd:char"), ("process_id", "int_8s"), ("ifo", "lstring"), ("snr", "real_8")))
    document = gzip.compress(f'<?xml version="1.0"?><LIGO_LW><Table Name="sngl_inspiral:table">{columns}<Stream Name="t" Delimiter=",">{rows}</Stream></Table></LIGO_LW>'.encode())
    tracemalloc.start()
    try:
        count = sum(len(c) // 4 for _, _, c in tables.ligolw_cells(gzip.open(io.BytesIO(document))))
        assert count == n and tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()
    (tmp_path / "e.xml.gz").write_bytes(document)
    t = tables.event_table(spark, str(tmp_path), "sngl_inspiral")
    assert t.selectExpr("count(*)", "sum(event_id)", "sum(process_id)", "max(snr)", "min(ifo)", "count(mass1)").first() == (n, n * (n - 1) // 2, sum(k % 7 for k in range(n)), (n - 1) * 0.5, "H1", 0)


def test_cells_are_the_same_wherever_pieces_end():
    cells = ["1", '"a,b"', '"q\\"u,\\\\"', "", "2.5", '""', '"\n,"', "", "7"]
    text = " , ".join(cells).replace('"', "&quot;")
    document = f'<LIGO_LW><Table Name="x:table">{"".join(f"<Column Name={chr(34)}c{k}{chr(34)} Type={chr(34)}lstring{chr(34)}/>" for k in range(3))}<Stream>{text}</Stream></Table></LIGO_LW>'.encode()

    class Pieces(io.BytesIO):
        def read(self, n=-1):
            return super().read(3)

    rows = [["1", "a,b", 'q"u,\\'], [None, "2.5", ""], ["\n,", None, "7"]]
    for stream in (io.BytesIO(document), Pieces(document)):
        (_, _, none), (name, _, got) = tables.ligolw_cells(stream)
        assert none == [] and name == "x" and [c.strip() for c in got] == cells
    assert tables.read_ligolw(document) == {"x": (["c0", "c1", "c2"], rows)}
    assert tables.read_ligolw(document.replace(b"7</Stream>", b"7 ,\n</Stream>"))["x"][1] == rows


def test_written_documents_are_read_again(spark, tmp_path):
    import pandas as pd

    t = spark.createDataFrame(pd.DataFrame({"doc": [1, 1, 2], "event_id": [3, 4, 5], "ifo": ['a"b\\<&>', None, "H1"], "snr": [1e-300, 0.1, None]}), "doc long, event_id long, ifo string, snr double")
    p = spark.createDataFrame([(2, 9)], "doc long, process_id long")
    done = tables.write_ligolw({"sngl_inspiral": t, "process": p}, "doc", str(tmp_path)).collect()
    assert sorted((r.key, r.bytes == os.path.getsize(r.path)) for r in done) == [("1", True), ("2", True)]
    own = {k: tables.read_ligolw((tmp_path / f"{k}.xml.gz").read_bytes()) for k in (1, 2)}
    assert own[1] == {"sngl_inspiral": (["event_id", "ifo", "snr"], [[3, 'a"b\\<&>', 1e-300], [4, None, 0.1]]), "process": (["process_id"], [])}
    assert own[2]["sngl_inspiral"][1][0][:2] == [5, "H1"] and own[2]["process"] == (["process_id"], [[9]])


def test_the_number_of_documents_grows_with_the_data(spark, tmp_path):
    n = 6 * extra.PER_DOCUMENT
    o = spark.range(n).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey")
    o.write.parquet(str(tmp_path / "orders.parquet"))
    o.selectExpr("o_orderkey AS l_orderkey", "'A' AS l_returnflag", "1.0D AS l_quantity", "0.5D AS l_discount", "2.0D AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    extra._write_documents(spark, str(tmp_path), str(tmp_path / "documents"))
    held = [r["count"] for r in tables.event_table(spark, str(tmp_path / "documents"), "coinc_event").groupBy("path").count().collect()]
    assert len(held) == 6 and sum(held) == n and max(held) < 1.1 * extra.PER_DOCUMENT
