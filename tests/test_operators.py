import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import distance as D
from skylattice.functions import gps
from skylattice.functions import index as ix
from skylattice.operators import credible, crossmatch, density, events, graph, image, localize, maps, moments, stats
from skylattice.plans import queries
from skylattice.sources import fits, tables


def test_index_values(spark):
    rows = spark.createDataFrame([(0, 0, 4), (0, 11, 15), (1, 0, 16), (1, 47, 63), (12, 0, 0x4000000), (29, 0, 0x1000000000000000), (29, 0x2FFFFFFFFFFFFFFF, 0x3FFFFFFFFFFFFFFF)], "o int, p long, u long")
    order, ipix = ix.uniq2nest("u")
    for r in rows.select("o", "p", "u", order.alias("a"), ipix.alias("b"), ix.nest2uniq("o", "p").alias("c")).collect():
        assert (r.a, r.b, r.c) == (r.o, r.p, r.u)
    bad = spark.createDataFrame([(-1,), (0,), (2,), (3,)], "u long").select(ix.uniq2order("u").alias("o"), ix.uniq2pixarea("u").alias("a"))
    assert all(r.o == -1 and math.isnan(r.a) for r in bad.collect())
    assert spark.range(1).select(ix.nest2uniq(F.lit(1), F.lit(-2))).first()[0] == -1


def test_rasterize_guard_and_roundtrip(spark):
    m = spark.range(12).select((F.col("id") + 4).alias("uniq"), F.col("id").cast("double").alias("v"))
    up = maps.rasterize(m, 2)
    assert up.count() == 192
    back = maps.derasterize(up, 2).orderBy("uniq").collect()
    assert [(r.uniq, r.v) for r in back] == [(k + 4, float(k)) for k in range(12)]
    with pytest.raises(MemoryError):
        maps.rasterize(m, 29)
    down = maps.rasterize(up.select(ix.nest2uniq(F.lit(2), F.col("ipix")).alias("uniq"), "v"), 0)
    assert sorted((r.ipix, r.v) for r in down.collect()) == [(k, float(k)) for k in range(12)]


def test_adaptive_grid_size_and_total(spark):
    g = maps.adaptive_grid(spark, lambda t, p: F.exp(F.cos(t)), 1, 2)
    assert g.count() == 48 + 2 * 36
    assert g.agg(F.sum(F.col("probdensity") * ix.uniq2pixarea("uniq"))).first()[0] == pytest.approx(1)
    assert g.agg(F.sum(ix.uniq2pixarea("uniq"))).first()[0] == pytest.approx(4 * math.pi)


def test_combine_of_hemispheres_raises_when_disjoint(spark):
    a = spark.range(12).select((F.col("id") + 4).alias("uniq"), F.when(F.col("id") < 6, 1.0).otherwise(0.0).alias("probdensity"))
    b = spark.range(12).select((F.col("id") + 4).alias("uniq"), F.when(F.col("id") >= 6, 1.0).otherwise(0.0).alias("probdensity"))
    assert maps.combine(a, a).agg(F.sum("probdensity")).first()[0] * 4 * math.pi / 12 == pytest.approx(1)
    with pytest.raises(Exception, match="zero everywhere"):
        maps.combine(a, b).collect()


def test_prefix_sums_agree(spark):
    m = spark.range(500).select((F.col("id") % 3).alias("map_id"), (F.col("id") + 4).alias("uniq"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("w"))
    a = credible.greedy_levels(m, "w", ["map_id"]).orderBy("uniq").collect()
    b = credible.greedy_levels(m, "w", ["map_id"], by_range=True).select("map_id", "uniq", "w", "cls").orderBy("uniq").collect()
    assert [(r.uniq, round(r.cls, 12)) for r in a] == [(r.uniq, round(r.cls, 12)) for r in b]


def test_marginal_moments_of_one_distance(spark):
    mu, sigma, norm = (float(v) for v in D.moments_to_parameters(100.0, 20.0))
    m = spark.range(12).select((F.col("id") + 4).alias("uniq"), F.lit(1 / 12).alias("prob"), F.lit(mu).alias("distmu"), F.lit(sigma).alias("distsigma"), F.lit(norm).alias("distnorm"))
    r = moments.marginal_moments(m).first()
    assert r.distmean == pytest.approx(100) and r.diststd == pytest.approx(20)
    median = moments.marginal_ppf(m, 0.5).first()[0]
    assert float(D.cdf(median, mu, sigma, norm)) == pytest.approx(0.5, abs=1e-6)


def test_crossmatch_of_uniform_map(spark):
    m = spark.range(48).select((F.col("id") + 16).alias("uniq"), F.lit(1 / (4 * math.pi)).alias("probdensity"))
    cat = crossmatch.catalog_points(spark.createDataFrame([(0, 0.1, 0.2), (1, 3.0, -1.0)], "id long, ra double, dec double"))
    rows = crossmatch.searched(m, cat).collect()
    assert len(rows) == 2 and all(0 < r.searched_prob <= 1.0000001 for r in rows)
    assert all(r.searched_area == pytest.approx(r.searched_prob * 41252.96, rel=1e-5) for r in rows)


def test_modes_and_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    assert {(r.root) for r in graph.components(edges).collect()} == {0, 100}
    assert crossmatch.count_modes(spark.createDataFrame([(0,), (1,), (100,)], "ipix long"), 2).first().modes == 2
    assert crossmatch.flood_fill(spark.range(192).withColumnRenamed("id", "ipix"), 2, 5).count() == 192


def test_exclusion_errors(spark):
    e = spark.createDataFrame([(1, [("H1", 5.0), ("L1", 6.0)])], "coinc_event_id long, singles array<struct<detector:string,snr:double>>")
    assert len(events.exclude_detectors(e, ["H1"]).first().singles) == 1
    with pytest.raises(Exception, match="no effect"):
        events.exclude_detectors(e, ["V1"]).collect()
    with pytest.raises(Exception, match="without data"):
        events.exclude_detectors(e, ["H1", "L1"]).collect()


def test_threshold_errors(spark):
    with pytest.raises(ValueError):
        stats.thresholds(spark.createDataFrame([(float("nan"),)], "snr double").where("snr < 0"), "snr")


def test_gps(spark):
    t = spark.createDataFrame([(1126259462.391,), (0.0,), (46828800.0,)], "g double")
    text = [r[0] for r in t.select(gps.gps_to_iso8601("g")).collect()]
    assert text == ["2015-09-14T09:50:45.391000", "1980-01-06T00:00:00.000000", "1981-06-30T23:59:59.000000"]
    back = [r[0] for r in t.select(gps.iso8601_to_gps(gps.gps_to_iso8601("g"))).collect()]
    assert back[:2] == pytest.approx([1126259462.391, 0.0])
    ids = spark.createDataFrame([("G1234",), ("coinc_event:coinc_event_id:7",), ("12",)], "s string")
    assert [r[0] for r in ids.select(gps.normalize_objid("s")).collect()] == ["G1234", "7", "12"]


def test_fits_roundtrip(spark, tmp_path):
    m = spark.range(12).select((F.col("id") + 4).alias("uniq"), (F.col("id") * 0.5).alias("probdensity"))
    fits.write_map(m, str(tmp_path / "a.fits.gz"), {"objid": "X1", "distmean": 12.5, "history": ["made by a test"]})
    back = fits.read_maps(spark, str(tmp_path / "*.fits.gz")).orderBy("uniq").collect()
    assert [(r.uniq, r.probdensity) for r in back] == [(k + 4, k * 0.5) for k in range(12)]
    meta = fits.read_metadata(spark, str(tmp_path / "*.gz")).first()
    assert meta.objid == "X1" and float(meta.distmean) == 12.5
    ring = fits.serialize({"ipix": np.arange(48), "prob": np.arange(48.0)}, nested=False)
    cards, columns = fits.parse(ring)
    flat = fits.standardize(cards, columns)
    assert cards["ORDERING"] == "RING" and sorted(flat["ipix"]) == list(range(48))
    with pytest.raises(ValueError):
        fits.standardize({**cards, "COORDSYS": "G"}, columns)


def test_data_source(spark, tmp_path):
    spark.dataSource.register(fits.SkymapSource)
    m = spark.range(12).select((F.col("id") + 4).alias("uniq"), (F.col("id") * 0.5).alias("probdensity"))
    m.coalesce(1).write.format("skymap_fits").mode("append").save(str(tmp_path / "b.fits"))
    assert spark.read.format("skymap_fits").load(str(tmp_path / "b.fits")).count() == 12


def test_event_documents(spark, tmp_path):
    xml = b"""<?xml version="1.0"?><LIGO_LW><Table Name="sngl_inspiral:table"><Column Name="sngl_inspiral:event_id" Type="ilwd:char"/><Column Name="ifo" Type="lstring"/><Column Name="snr" Type="real_4"/>
    <Stream Name="t" Type="Local" Delimiter=",">"sngl_inspiral:event_id:1","H1",5.5,"sngl_inspiral:event_id:2","L1",6.5</Stream></Table></LIGO_LW>"""
    assert tables.read_ligolw(xml)["sngl_inspiral"] == (["event_id", "ifo", "snr"], [[1, "H1", 5.5], [2, "L1", 6.5]])
    path = str(tmp_path / "e.sqlite")
    with tables.open_sqlite(path, "w") as db:
        db.execute("CREATE TABLE coinc_event (coinc_event_id INTEGER, kind TEXT)")
        db.execute("INSERT INTO coinc_event VALUES (3, 'x')")
    db.close()
    assert tables.event_tables(spark, path)["coinc_event"].first().coinc_event_id == 3
    with pytest.raises(ValueError):
        tables.open_sqlite("-")
    assert tables.kind_of_events(b"\x89HDF\r\n\x1a\n....") == "hdf"


def test_samples(spark, tmp_path):
    p = tmp_path / "chain.txt"
    p.write_text("# right_ascension declination logdistance\n1.0 0.5 2.0\n1.1 0.4 2.5\n")
    s = tables.read_samples(spark, str(p))
    assert set(s.columns) == {"ra", "dec", "distance"} and s.count() == 2
    fixed = tables.write_samples(s.withColumn("mass", F.lit(1.0)), str(tmp_path / "c.parquet"))
    assert fixed == {"mass": 1.0}


def test_stream(spark, tmp_path):
    from skylattice.plans.queries import _toy_events
    from skylattice.streaming.localize import localize_stream

    folder = str(tmp_path / "in")
    e = _toy_events(spark, 1)
    e.write.parquet(folder)
    alerts = spark.readStream.schema(e.schema).parquet(folder)
    q = localize_stream(alerts, str(tmp_path / "maps"), str(tmp_path / "failed"), str(tmp_path / "cp"), top_order=0, rounds=0, n_psi=2, n_u=2)
    q.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "maps")).count() == 12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables aren't here")
def test_map_from_samples_takes_all_samples_and_the_whole_search(spark, monkeypatch):
    class Asked(Exception):
        pass

    def fit(spark, points, max_k=40, trials=5, seed=0):
        raise Asked(len(points), max_k, trials)

    monkeypatch.setattr(density, "fit_clustered", fit)
    with pytest.raises(Asked) as found:
        queries.map_from_samples(spark, "/root/testdata/sf0.1")
    assert found.value.args == (spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").count(), 40, 5)


def test_find_floor_counts_in_many_tasks(spark):
    rng = np.random.default_rng(2)
    x, at = rng.integers(-50, 5000, 20_000), np.sort(rng.integers(0, 4500, 300))
    values = spark.createDataFrame([(int(v), k) for k, v in enumerate(x)] + [(None, -1)], "x long, n long")
    ladder = spark.createDataFrame([(int(v),) for v in at], "at long")
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so small a table is one task
    try:
        got = crossmatch.find_floor(values, ladder)
        rows = got.select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    want = np.searchsorted(at, x, "right") - 1
    assert len(rows) == len(x) + 1 and all(r.floor == (want[r.n] if r.n >= 0 else -1) for r in rows)
    assert len({r.task for r in rows}) > 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
@pytest.mark.parametrize("module, operator, names", [(crossmatch, "searched_volume", ["crossmatch_3d"]), (crossmatch, "contour_volumes", ["contour_volumes"]), (image, "volume_render", ["volume_render"]), (localize, "localize", ["localize_events"])])
def test_queries_keep_the_grids_of_their_operators(spark, monkeypatch, module, operator, names):
    asked, real = [], getattr(module, operator)

    def noted(*a, **options):
        asked.append(options)
        return spark.range(0) if operator == "localize" else real(*a, **options)  # a localisation at full settings takes minutes

    monkeypatch.setattr(module, operator, noted)
    for name in names:
        getattr(queries, name)(spark, "/root/testdata/sf0.001")
    assert asked == [{}] * len(names)
