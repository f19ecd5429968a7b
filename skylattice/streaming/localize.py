"""Localisation of alerts as they arrive."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import fields
from ..operators.localize import localize
from ..operators.maps import rasterize
from ..sources import fits
from ..storage import spill

FAILED = "event_id:string,stage:string,error:string"


def publish_maps(maps: DataFrame, publish: Callable[[str, str, bytes], None], order: int | None = None) -> DataFrame:
    """(event_id, stage, error) of the maps that could not be published; all others were.

    ``publish(event_id, name, content)`` runs in tasks, one map each, with ``<event>.multiorder.fits`` and, with ``order``, the
    flattened ``<event>.fits.gz``.  What it raises is a row, and the others go on.  A task that is run again publishes the same content
    under the same name, which is to replace what is there.
    """
    layers = ["distmu", "distsigma", "distnorm"]

    def send(name: str, columns: list[str], stage: str):
        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            file = name.format(key[0])
            try:
                content = fits.serialize({c: rows[c].to_numpy(np.int64 if c in ("uniq", "ipix") else float) for c in columns}, {"objid": key[0]})
                if file.endswith(".gz"):
                    import gzip

                    content = gzip.compress(content, mtime=0)
                publish(key[0], file, content)
            except Exception as error:  # whatever a service's client may raise
                return pd.DataFrame([(key[0], stage, f"{type(error).__name__}: {error}")], columns=["event_id", "stage", "error"])
            return pd.DataFrame([], columns=["event_id", "stage", "error"])

        return one

    whole = maps.select("event_id", "uniq", "probdensity", *layers)
    out = whole.groupBy("event_id").applyInPandas(send("{}.multiorder.fits", ["uniq", "probdensity", *layers], "publish"), fields(FAILED))
    if order is not None:
        flat = rasterize(maps.select("event_id", "uniq", "probdensity"), order, ["event_id"]).withColumn("prob", F.col("probdensity") * (math.pi / 3 * 0.25**order))
        out = out.unionByName(flat.groupBy("event_id").applyInPandas(send("{}.fits.gz", ["ipix", "prob"], "publish flat"), fields(FAILED)))
    return out


def localize_stream(alerts: DataFrame, maps_path: str, failed_path: str, checkpoint: str, trigger: dict | None = None, publish: Callable[[str, str, bytes], None] | None = None, flatten: int | None = None, **options):
    """Start a query that localises each micro-batch of events, writes its maps, and publishes them if asked.

    An event that fails goes to the table of failures (event_id, stage, error) and the stream goes on.  A micro-batch has a folder of its own in
    either table (``batch=N``) and replaces it, so that a batch repeated after a failure leaves the same rows as one; a marker is the last that is written, and a batch that has
    it isn't done again.  So a restart in mid-batch loses and repeats nothing; published names are written over by the same content.
    """

    def handle(batch: DataFrame, number: int) -> None:
        marker = f"{maps_path}/_done/{number}"
        system, name = fits.file_system(marker)
        if system.get_file_info(name).type.name != "NotFound":
            return
        maps = spill(localize(batch, keep_going=True, **options))
        good = maps.where(F.col("uniq").isNotNull())
        good.write.mode("overwrite").parquet(f"{maps_path}/batch={number}")
        failed = maps.where(F.col("uniq").isNull()).select("event_id", F.lit("localize").alias("stage"), F.lit(None).cast("string").alias("error"))
        if publish is not None:
            failed = failed.unionByName(spill(publish_maps(good, publish, flatten)))
        failed.write.mode("overwrite").parquet(f"{failed_path}/batch={number}")
        fits.save(b"", marker)

    return alerts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
