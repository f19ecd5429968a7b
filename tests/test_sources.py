"""Sources, sinks and functions that queries don't reach: edge cases and plain values."""

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import gps, interpolate, signal, text
from skylattice.operators import density, events, localize, mixture
from skylattice.sources import fits, tables


def test_documents_keep_quotes_nulls_and_empty_tables():
    rows = [[1, 'q"u,o\\te <&>', 1.5], [None, None, None], [3, "", 2.0], [4, "z", None]]
    d = tables.ligolw_document({"x": ("a:long,b:string,c:double", rows), "e": ("a:long", []), "o": ("a:long", [[5]])})
    assert tables.read_ligolw(d) == {"x": (["a", "b", "c"], rows), "e": (["a"], []), "o": (["a"], [[5]])}


def test_event_tables_read_every_file(spark, tmp_path):
    import gzip

    for k in range(3):
        d = tables.ligolw_document({"coinc_event": ("coinc_event_id:long,coinc_def_id:long", [[k, 0], [10 + k, 1]])})
        (tmp_path / f"{k}.xml{'.gz' if k else ''}").write_bytes(gzip.compress(d) if k else d)
    (tmp_path / "none.xml").write_bytes(tables.ligolw_document({"process": ("process_id:long", [])}))
    db = sqlite3.connect(tmp_path / "e.sqlite")
    db.execute("CREATE TABLE coinc_event (coinc_event_id INTEGER, extra TEXT)")
    db.execute("INSERT INTO coinc_event VALUES (99, 'x')")
    db.commit()
    db.close()
    t = tables.event_table(spark, str(tmp_path), "coinc_event")
    assert t.columns == ["path", "coinc_event_id", "coinc_def_id", "process_id", "time_slide_id"]
    assert sorted(r.coinc_event_id for r in t.collect()) == [0, 1, 2, 10, 11, 12, 99] and t.select("path").distinct().count() == 4
    assert tables.event_table(spark, str(tmp_path), "process").count() == 0


def test_series_of_documents(spark, tmp_path):
    xml = b"""<?xml version="1.0"?><LIGO_LW><LIGO_LW Name="psd"><LIGO_LW Name="REAL8FrequencySeries"><Time Name="epoch" Type="GPS">5</Time><Param Name="f0:param" Type="real_8">0</Param><Param Name="instrument:param" Type="lstring">H1</Param>
    <Array Name="PSD:array" Type="real_8"><Dim Name="Frequency" Start="0" Scale="0.5">3</Dim><Dim Name="Frequency,Real">2</Dim><Stream Type="Local" Delimiter=" ">0 1 0.5 2 1 3</Stream></Array></LIGO_LW></LIGO_LW>
    <LIGO_LW Name="COMPLEX8TimeSeries"><Time Name="epoch" Type="GPS">100.5</Time><Param Name="event_id:param" Type="ilwd:char">sngl_inspiral:event_id:7</Param>
    <Array Name="snr:array" Type="real_8"><Dim Name="Time" Start="0" Scale="0.25">2</Dim><Dim Name="Time,Real,Imaginary">3</Dim><Stream Type="Local" Delimiter=" ">0 1 2 0.25 3 4</Stream></Array></LIGO_LW></LIGO_LW>"""
    (tmp_path / "a.xml").write_bytes(xml)
    p = tables.psd_series(spark, str(tmp_path)).first()
    assert (p.ifo, p.f0, p.df, p.data) == ("H1", 0.0, 0.5, [1.0, 2.0, 3.0])
    s = tables.snr_series(spark, str(tmp_path)).first()
    assert (s.event_id, s.epoch, s.rate, s.snr_re, s.snr_im) == (7, 100.5, 4.0, [1.0, 3.0], [2.0, 4.0])


def test_sources_of_events(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "coinc_event_id long, v string")
    source = tables.EventSource(rows)
    assert len(source) == 2 and list(source) == [1, 2] and source["2"].v == "b" and dict(source.items())[1].v == "a"
    with pytest.raises(KeyError):
        source[3]


def test_one_table_of_the_name(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "a" / "posterior_samples.parquet"))
    assert tables.find_table(spark, str(tmp_path)).endswith("posterior_samples.parquet")
    spark.range(1).write.parquet(str(tmp_path / "b" / "posterior_samples"))
    for folder, n in ((tmp_path, 2), (tmp_path / "a" / "posterior_samples.parquet", 0)):
        with pytest.raises(ValueError, match=f"{n} tables"):
            tables.find_table(spark, str(folder))


def test_layout_of_tables(spark):
    empty = lambda s: spark.createDataFrame([], s)
    coincs, bank = empty("coinc_id long, template_id long, trigger_ids array<long>"), empty("template long, mass1 double, mass2 double")
    found = tables.hdf_tables([bank, coincs, empty("snr double, coa_phase double, end_time double")])
    assert found["coincs"] is coincs and len(found["triggers"]) == 1 and found["psds"] == []
    with pytest.raises(ValueError):
        tables.hdf_tables([bank])


def test_templates_by_index(spark):
    bank = spark.createDataFrame([(0, 1.0), (1, 2.0)], "template long, mass1 double")
    t = spark.createDataFrame([(7, 1)], "id long, template_id long")
    assert events.template_of(t, bank).first().mass1 == 2.0
    with pytest.raises(Exception, match="outside the bank"):
        events.template_of(t.withColumn("template_id", F.lit(5)), bank).collect()


def test_phase_conventions(spark):
    t = spark.createDataFrame([("pycbc",), ("gstlal_inspiral",), (None,)], "program string")
    assert [r[0] for r in t.select(events.invert_phase(F.col("program"))).collect()] == [False, True, False]
    with pytest.raises(Exception, match="unknown"):
        t.select(events.invert_phase(F.lit("other"))).collect()
    assert t.select(events.invert_phase(F.lit("other"), {"other": True})).first()[0]


def test_duty_cycle_does_not_depend_on_partitions(spark):
    t = spark.range(2000).select((F.col("id") % 500).alias("coinc_id"), F.concat(F.lit("D"), F.col("id") % 4).alias("ifo"), F.lit(8.0).alias("snr"))
    cut = lambda d: sorted(map(tuple, events.detection_cuts(d, ["coinc_id"], 4.0, 12.0, 2, duty_cycle=0.7, seed=3).collect()))
    assert cut(t) == cut(t.repartition(7)) and 0 < len(cut(t)) < 2000


def test_writer_wants_one_partition_and_leaves_no_parts(spark, tmp_path):
    spark.dataSource.register(fits.SkymapSource)
    m = spark.range(8, 20).select((F.col("id") + 8).alias("uniq"), F.lit(1.0).alias("probdensity"))
    with pytest.raises(Exception, match="one map from one partition"):
        m.repartition(3).write.format("skymap_fits").mode("append").save(str(tmp_path / "a.fits"))
    assert list(tmp_path.iterdir()) == []
    m.coalesce(1).write.format("skymap_fits").mode("append").save(str(tmp_path / "a.fits"))
    with pytest.raises(Exception, match="exists"):
        m.coalesce(1).write.format("skymap_fits").mode("append").save(str(tmp_path / "a.fits"))
    assert [p.name for p in tmp_path.iterdir()] == ["a.fits"]


def test_metadata_of_maps():
    meta = {"objid": "x:y:12", "gps_time": 1126259462.391, "instruments": {"L1", "H1"}, **fits.version_metadata("1.0", "abc"), **fits.provenance("tool", ["--a b", "c"], 10.0, 12.5)}
    cards, _ = fits.parse(fits.serialize({"uniq": np.arange(4, 16), "probdensity": np.ones(12)}, meta))
    assert cards["DATE-OBS"] == "2015-09-14T09:50:45.391000" and cards["MJD-OBS"] == pytest.approx(57279.410247581016)
    back = fits.metadata(cards)
    assert back["objid"] == 12 and back["gps_time"] == pytest.approx(1126259462.391) and back["instruments"] == ["H1", "L1"]
    assert back["vcs_version"] == "skylattice 1.0" and back["runtime"] == 2.5 and any("--a b" in h for h in back["history"])
    assert gps.gps_of(gps.iso8601_of(1e9 + 0.25)) == 1e9 + 0.25


def test_cells_are_merged_to_parents():
    assert fits.merged_cells(np.arange(64, 68)).tolist() == [16]
    assert fits.merged_cells(np.concatenate([np.arange(64, 67), np.arange(80, 96)])).tolist() == [5, 64, 65, 66]


def test_interpolation_with_gaps_and_edges():
    x = np.linspace(0, 1, 11)
    f = interpolate.Cubic(np.sin(x), 0.0, 0.1)
    assert np.allclose(f(np.linspace(0.1, 0.9, 50)), np.sin(np.linspace(0.1, 0.9, 50)), atol=1e-4)
    assert f(np.array([-5.0]))[0] == 0.0 and f(np.array([9.0]))[0] == pytest.approx(math.sin(1)) and np.isnan(f(np.array([np.nan])))[0]
    gap = interpolate.Cubic([0.0, 1.0, 2.0, np.inf, 4.0], 0.0, 1.0)
    assert gap(np.array([1.5]))[0] == 1.5 and gap(np.array([2.5]))[0] == 2.0
    g = interpolate.Bicubic(np.add.outer(x, 2 * x), (0, 0), (0.1, 0.1))
    assert g(np.array([0.33]), np.array([0.47]))[0] == pytest.approx(1.27)


def test_waveforms_and_texts():
    assert signal.approximant_and_orders("TaylorT4threePointFivePN") == ("TaylorT4", 7, 7)
    assert signal.approximant_and_orders("restrictedTaylorF2twoPN") == ("TaylorF2", 0, 4)
    assert signal.waveform_of("o2-uberbank", 1.4, 1.4).startswith("TaylorF2") and signal.waveform_of("o2-uberbank", 10, 10) == "SEOBNRv4_ROM"
    f = np.array([20.0, 100.0])
    assert np.allclose(signal.merger_psd(10, 10)(f), signal.inspiral_psd(10, 10)(f))
    late = signal.merger_psd(10, 10)(np.linspace(200, 2000, 500))
    assert late.max() > 0 and late[-1] == 0 and signal.template_psd("TaylorF2", 10, 10)(np.array([300.0]))[0] == 0
    with pytest.raises(ValueError):
        signal.approximant_and_orders("nothing")
    assert signal.vectorized_psd(lambda x: 1 / x)(np.array([0.0, 2.0])).tolist() == [math.inf, 0.5]
    assert [text.area_text(a) for a in (0.345678, 3.45678, 34.5678, 345.678, 3456.78, 34567.8)] == ["0.346", "3.46", "34.6", "346", "3,457", "34,568"]
    assert text.scientific(12345, 2) == "12300" and text.plain_number(text.scientific(0.00123, 2)) == pytest.approx(0.00123)


def test_mixture_and_chain(spark):
    rng = np.random.default_rng(0)
    ra, dec = np.concatenate([rng.normal(1, 0.05, 300), rng.normal(4, 0.1, 150)]), np.concatenate([rng.normal(0.3, 0.05, 300), rng.normal(-0.4, 0.1, 150)])
    m = mixture.SkyMixture(ra, dec)
    from skylattice.functions import healpix

    t, p = healpix.pix2ang(7, np.arange(12 * 4**7))
    d = m(t, p)
    assert d.sum() * 4 * np.pi / len(d) == pytest.approx(1, abs=0.03)
    assert abs(p[d.argmax()] - 1) < 0.1 and abs(np.pi / 2 - t[d.argmax()] - 0.3) < 0.1
    assert m.as_map(spark, 1, 1).count() == 48 + 3 * 12
    chain = spark.createDataFrame([("e", float(a), float(b), float(100 + k % 7)) for k, (a, b) in enumerate(zip(ra, dec))], "event_id string, ra double, dec double, distance double")
    maps = localize.chain_maps(chain, 60, top_order=0, rounds=0, max_k=1, trials=1)
    assert list(maps) == ["e"] and maps["e"].count() == 12
    assert isinstance(density.GaussianKDE(np.zeros((1, 2))), density.GaussianKDE)


def test_split_localisation_equals_that_of_one_task(spark):
    from skylattice.plans.queries import _toy_events

    e = _toy_events(spark, 2)
    options = dict(top_order=0, rounds=1, n_psi=2, n_u=2)
    rows = lambda d: sorted((r.event_id, r.uniq, round(r.probdensity, 9), round(r.log_bci, 9)) for r in d.collect())
    assert rows(localize.localize(e, split=True, block=5, **options)) == rows(localize.localize(e, split=False, **options))
    twice = e.unionByName(e.limit(1))
    for split in (True, False):
        bad = localize.localize(twice, keep_going=True, split=split, **options).where("uniq IS NULL").collect()
        assert [r.event_id for r in bad] == ["0"]
        with pytest.raises(Exception, match="several rows|has 2 rows"):
            localize.localize(twice, split=split, **options).collect()
