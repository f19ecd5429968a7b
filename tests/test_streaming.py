"""Localisation of alerts as a stream: restarts, failures, publishing."""

import os

import pytest

from skylattice.sources import fits
from skylattice.streaming.localize import localize_stream

FAST = dict(top_order=0, rounds=0, n_psi=2, n_u=2)


def service(path, refused=None):
    """A service that keeps files by name; refuses what belongs to one event."""

    def publish(event, name, content):
        from skylattice.sources import fits

        if event == refused:
            raise ConnectionError("refused")
        fits.save(content, f"{path}/{name}")

    return publish


def arrived(spark, folder):
    """Three events in a file each, one of them without detectors."""
    from skylattice.plans.queries import _toy_events

    e = _toy_events(spark, 2)
    bad = spark.createDataFrame([("bad", [])], e.schema)
    for k, one in enumerate((e.where("event_id = '0'"), e.where("event_id = '1'"), bad)):
        one.coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_restart_in_mid_batch_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    alerts = arrived(spark, str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("maps", "failed", "checkpoint")]
    kept = str(tmp_path / "service")
    real, crashed = fits.save, []

    def crash(data, path):
        if path.endswith("_done/1") and not crashed:
            crashed.append(path)
            raise RuntimeError("the driver is gone")
        real(data, path)

    monkeypatch.setattr(fits, "save", crash)
    q = localize_stream(alerts, *paths, publish=service(kept), flatten=1, **FAST)
    with pytest.raises(Exception, match="the driver is gone"):
        q.awaitTermination(300)
    assert crashed and not os.path.exists(f"{paths[0]}/_done/1")
    q = localize_stream(alerts, *paths, publish=service(kept), flatten=1, **FAST)
    q.awaitTermination(300)
    maps = spark.read.parquet(paths[0])
    assert sorted((r.event_id, r["count"]) for r in maps.groupBy("event_id").count().collect()) == [("0", 12), ("1", 12)]
    assert [(r.event_id, r.stage) for r in spark.read.parquet(paths[1]).collect()] == [("bad", "localize")]
    assert sorted(os.listdir(kept)) == ["0.fits.gz", "0.multiorder.fits", "1.fits.gz", "1.multiorder.fits"]
    assert sorted(os.listdir(f"{paths[0]}/_done")) == ["0", "1", "2"]
    back = fits.read_maps(spark, f"{kept}/0.multiorder.fits")
    want = {r.uniq: r.probdensity for r in maps.where("event_id = 0").collect()}
    assert {r.uniq: r.probdensity for r in back.collect()} == pytest.approx(want)
    flat = fits.read_maps(spark, f"{kept}/1.fits.gz", ("prob",), moc=False)
    assert flat.count() == 48 and sum(r.prob for r in flat.collect()) == pytest.approx(1, abs=1e-6)


def test_what_a_service_refuses_is_a_row(spark, tmp_path):
    alerts = arrived(spark, str(tmp_path / "in"))
    kept = str(tmp_path / "service")
    q = localize_stream(alerts, *[str(tmp_path / n) for n in ("maps", "failed", "checkpoint")], publish=service(kept, refused="1"), **FAST)
    q.awaitTermination(300)
    failed = sorted((r.event_id, r.stage, r.error) for r in spark.read.parquet(str(tmp_path / "failed")).collect())
    assert [f[:2] for f in failed] == [("1", "publish"), ("bad", "localize")] and failed[0][2] == "ConnectionError: refused"
    assert os.listdir(kept) == ["0.multiorder.fits"]
