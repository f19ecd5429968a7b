"""Every registered query of the core against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import pytest

import __spark_entry__ as entry
from skylattice.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
