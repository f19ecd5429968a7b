"""Queries on directions that lie on the edges of pixels, against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

from skylattice.plans import queries as core

SF = "/root/testdata/sf0.001"
#: Customers whose direction is on the meridian 0 and on an edge of pixels.
ON_EDGES = [57148, 114296, 299556, 777464, 1077020, 1198224]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["direction_to_cell", "searched_modes"])
def test_against_sql(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame([(k,) for k in [*ON_EDGES, *range(40)]], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(f"{SF}/orders.parquet").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = core.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(core.ORACLE_SQL[name]).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values))
    assert rows(got) == rows(want) and len(got) == 46 * (4 if name == "searched_modes" else 1)
