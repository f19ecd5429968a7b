"""Queries on keys whose product leaves 64 bits, against their SQL with that product in 128 bits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import healpix
from skylattice.plans import extra, fixtures
from skylattice.plans import queries as core

SF = "/root/testdata/sf0.001"
PRODUCT = "((l_orderkey * 1000003 + l_partkey * 10007) * 1299709)"
WIDE = "((l_orderkey * 1000003 + l_partkey * 10007)::HUGEINT * 1299709)"
NAMES = ["adaptive_histogram", "crossmatch_searched", "flat_bitmap", "large_map_contours", "large_map_levels", "large_map_locate", "locate_points", "tree_leaves", "tree_leaves_in_sql"]
FAR = ["crossmatch_searched", "flat_bitmap", "large_map_locate", "locate_points", "tree_leaves", "tree_leaves_in_sql"]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The small tables with the keys of the last of sixty copies of sf0.1, and beyond."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("large"))
    duck = duckdb.connect()
    for name, shifts in (("orders", {"o_orderkey": 8_850_000}), ("lineitem", {"l_orderkey": 8_850_000, "l_partkey": 1_180_000})):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t = t.withColumns({c: F.col(c) * F.lit(1 if c != "l_orderkey" else 3) + by for c, by in shifts.items()})
        t.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, duck


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_against_wide_sql(spark, large, name):
    folder, duck = large
    got, sql = core.QUERIES[name](spark, folder).toPandas(), core.ORACLE_SQL[name]
    assert PRODUCT in sql
    # the pixel is cast back, so that shifts and bits are those of 64 bits again
    want = duck.sql(sql.replace(f"{PRODUCT} % {fixtures.PIXELS_29}", f"({WIDE} % {fixtures.PIXELS_29})::BIGINT")).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d.notna(), None).astype(str).values))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pixels_of_lines_at_the_edges(spark):
    keys = [(0, 0), (1, 1), (149_999, 19_999), (8_999_999, 1_199_999), (9_000_000_000_000, 9_999_999), (-8_999_999, 5), (-1, 0)]
    got = spark.createDataFrame(keys, "l_orderkey long, l_partkey long").select("l_orderkey", "l_partkey", fixtures.line_pixels().alias("p")).collect()
    for o, q, p in got:
        a = (o * 1000003 + q * 10007) * 1299709
        assert p == (abs(a) % fixtures.PIXELS_29) * (1 if a >= 0 else -1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_modes_of_the_large_map(spark, large):
    """As many modes as a flood over the touching cells of each region finds."""
    folder, _ = large
    got = {r.level: r.modes for r in core.QUERIES["large_map_modes"](spark, folder).collect()}
    cells = extra._large_map(spark, folder).orderBy(F.desc("w"), "uniq").toPandas()
    share = cells["w"].cumsum() / cells["w"].sum()
    for level in (0.5, 0.9):
        left, modes = set(cells["uniq"][share <= level] - 4**10), 0
        while left:
            modes, todo = modes + 1, [left.pop()]
            while todo:
                near = left.intersection(healpix.neighbours(9, np.array([todo.pop()]))[0].tolist())
                left -= near
                todo += near
        assert got[level] == modes


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The small tables with keys of which even the sum of products leaves 64 bits."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("far"))
    duck = duckdb.connect()
    for name, shifts in (("orders", {"o_orderkey": 59 * 10**12}), ("lineitem", {"l_orderkey": 59 * 10**12, "l_partkey": 59 * 10**12})):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.withColumns({c: F.col(c) + by for c, by in shifts.items()}).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, duck


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", FAR)
def test_sums_beyond_64_bits(spark, far, name):
    folder, duck = far
    got, sql = core.QUERIES[name](spark, folder).toPandas(), core.ORACLE_SQL[name]
    assert PRODUCT in sql
    wide = "((l_orderkey::HUGEINT * 1000003 + l_partkey::HUGEINT * 10007) * 1299709)"
    want = duck.sql(sql.replace(f"{PRODUCT} % {fixtures.PIXELS_29}", f"({wide} % {fixtures.PIXELS_29})::BIGINT")).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d.notna(), None).astype(str).values))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_modes_beyond_64_bits(spark, far):
    """The modes of the map as SQL in 128 bits has it."""
    from skylattice.operators import crossmatch

    folder, duck = far
    sql = extra._LARGE.replace(f"{PRODUCT} % {fixtures.PIXELS_29}", f"((l_orderkey::HUGEINT * 1000003 + l_partkey::HUGEINT * 10007) * 1299709 % {fixtures.PIXELS_29})::BIGINT")
    cells = duck.sql(f"WITH {sql} SELECT uniq, w::DOUBLE AS probdensity FROM large").df()
    cells["probdensity"] /= cells["probdensity"].sum() * 4 * np.pi / 3145728
    want = crossmatch.contour_modes(spark.createDataFrame(cells), [0.5, 0.9])
    assert sorted(core.QUERIES["large_map_modes"](spark, folder).collect()) == sorted(want.collect())


def test_pixels_of_all_keys_of_64_bits(spark):
    top = 2**63 - 1
    keys = [(top, top), (-top - 1, -top - 1), (top, -top), (10007, -1000003), (10007, -1000004), (-10007, 1000002), (59 * 10**12, 59 * 10**12), (-(2**32), 1), (2**32 - 1, 2**32 - 1), (None, 1)]
    got = spark.createDataFrame(keys, "l_orderkey long, l_partkey long").select("l_orderkey", "l_partkey", fixtures.line_pixels().alias("p")).collect()
    for o, q, p in got:
        a = None if o is None else (o * 1000003 + q * 10007) * 1299709
        assert p == (None if a is None else (abs(a) % fixtures.PIXELS_29) * (1 if a >= 0 else -1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_located_points_of_keys_times_seven(spark, tmp_path):
    """Keys of which seven times one leaves 64 bits."""
    import duckdb

    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    t.withColumn("l_orderkey", F.col("l_orderkey") * 10**14 + 59 * 10**17).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    sql, seven = core.ORACLE_SQL["large_map_locate"], "(l_orderkey * 7 + l_linenumber) % 3145728"
    assert PRODUCT in sql and seven in sql
    wide = sql.replace(f"{PRODUCT} % {fixtures.PIXELS_29}", f"((l_orderkey::HUGEINT * 1000003 + l_partkey * 10007) * 1299709 % {fixtures.PIXELS_29})::BIGINT")
    want = duck.sql(wide.replace(seven, "((l_orderkey::HUGEINT * 7 + l_linenumber) % 3145728)::BIGINT")).fetchall()
    got = core.QUERIES["large_map_locate"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == want and want[0][0] > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_modes_without_lines_that_have_no_pixel(spark, tmp_path):
    """Lines without a key take no part in the modes; no lines have none."""
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    key = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("long")).otherwise(F.col("l_orderkey"))
    keyed = t.withColumn("l_orderkey", key)
    for name, rows in (("some", keyed), ("rest", keyed.where("l_orderkey IS NOT NULL")), ("none", keyed.limit(0))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    some, rest, none = ({r.level: r.modes for r in core.QUERIES["large_map_modes"](spark, f"{tmp_path}/{name}").collect()} for name in ("some", "rest", "none"))
    assert some == rest and all(n > 0 for n in rest.values())
    assert none == {0.5: 0, 0.9: 0}
