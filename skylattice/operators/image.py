"""Images from maps: nearest-cell reprojection and volume rendering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from .crossmatch import catalog_points, locate


def grid(spark, width: int, height: int, projection: str = "CAR") -> DataFrame:
    """(x, y, ra, dec) of pixel centres over the whole sky; ra and dec are null outside the image.

    CAR: plate carree, longitude to the left.  MOL: Mollweide.  ARC: zenithal equidistant about the north pole.
    """
    p = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    u = 2 * (F.col("x") + 0.5) / width - 1
    v = 2 * (F.col("y") + 0.5) / height - 1
    if projection == "CAR":
        return p.select("x", "y", F.pmod(-u * math.pi, F.lit(2 * math.pi)).alias("ra"), (v * math.pi / 2).alias("dec"))
    if projection == "MOL":
        t = F.asin(v)
        lon = u * math.pi / F.cos(t)
        dec = F.asin((2 * t + F.sin(2 * t)) / math.pi)
        return p.select("x", "y", F.when(F.abs(lon) <= math.pi, F.pmod(-lon, F.lit(2 * math.pi))).alias("ra"), F.when(F.abs(lon) <= math.pi, dec).alias("dec"))
    if projection == "ARC":
        r = F.sqrt(u * u + v * v) * math.pi
        return p.select("x", "y", F.when(r <= math.pi, F.pmod(F.atan2(u, -v), F.lit(2 * math.pi))).alias("ra"), F.when(r <= math.pi, math.pi / 2 - r).alias("dec"))
    raise ValueError(f"unknown projection {projection}")


def reproject(pixels: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """(x, y, value, footprint): value of the cell under each pixel's centre; 0 footprint and null outside."""
    inside = catalog_points(pixels.where(F.col("ra").isNotNull()))
    hit = locate(inside, cells.select("uniq", value)).select("x", "y", value)
    return pixels.select("x", "y").join(hit, ["x", "y"], "left").withColumn("footprint", F.when(F.col(value).isNotNull(), 1).otherwise(0))


def volume_render(cells: DataFrame, size: int, max_distance: float, rotation=None, axis0: int = 0, axis1: int = 1, steps: int = 200, reach: float | None = None) -> DataFrame:
    """(i, j, density): line-of-sight integrals through a 3-D map, over a square image of side 2 * max_distance.

    Every point of every ray is a row that meets its cell in an equi-join, so neither the map nor the image has
    to fit in a task.  ``rotation`` turns the frame of the image.  Rays end at ``reach``, by default behind the farthest cell's
    mean and six of its widths, so that no density is left out; steps grow in number with it.
    """
    if reach is None:
        far = cells.where(F.col("distmu") < float("inf")).agg(F.max(F.greatest(F.col("distmu"), F.lit(0.0)) + 6 * F.col("distsigma"))).first()[0]
        reach = max(1.5 * max_distance, float(far or 0.0))
        steps = max(steps, int(steps * reach / (1.5 * max_distance)))
    spark = cells.sparkSession
    r = np.eye(3) if rotation is None else np.asarray(rotation, float)
    axis2 = 3 - axis0 - axis1
    step = 2 * max_distance / size
    rays = spark.range(size * size).select((F.col("id") % size).cast("int").alias("i"), F.floor(F.col("id") / size).cast("int").alias("j"))
    # steps crowd towards the image plane, where the density varies most
    s = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: -1 + 2 * k / (steps - 1))).alias("s")
    along = rays.select("i", "j", s)
    a, b = (F.col("i") + 0.5) * step - max_distance, (F.col("j") + 0.5) * step - max_distance
    c = F.col("s") * F.abs("s") * reach
    width = 2 * F.abs("s") * reach * (2 / (steps - 1))
    own = {axis0: a, axis1: b, axis2: c}
    xyz = [sum((float(r[k, m]) * own[k] for k in (1, 2)), float(r[0, m]) * own[0]) for m in range(3)]
    point = along.select("i", "j", width.alias("w"), *[q.alias(n) for q, n in zip(xyz, "xyz")])
    radius = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    point = point.withColumn("r", radius).withColumn("ra", F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi))).withColumn("dec", F.asin(F.col("z") / F.col("r")))
    hit = locate(catalog_points(point.where("r > 0")), cells.select("uniq", "probdensity", "distmu", "distsigma", "distnorm"))
    value = F.col("probdensity") * D.conditional_pdf("r", "distmu", "distsigma", "distnorm") / (F.col("r") * F.col("r"))
    return hit.groupBy("i", "j").agg(F.sum(value * F.col("w")).alias("density"))


def three_views(cells: DataFrame, axes, mean: float, std: float, size: int = 64) -> dict[str, DataFrame]:
    """Renderings along the principal axes, out to mean + 2.5 std."""
    far = mean + 2.5 * std
    return {f"{a}{b}": volume_render(cells, size, far, axes, a, b) for a, b in ((0, 1), (0, 2), (1, 2))}


def rotate_samples(samples: DataFrame, axes) -> DataFrame:
    """Add x, y, z of (ra, dec, distance) in the frame of ``axes`` (rows)."""
    v = [F.col("distance") * F.cos("dec") * F.cos("ra"), F.col("distance") * F.cos("dec") * F.sin("ra"), F.col("distance") * F.sin("dec")]
    return samples.select("*", *[sum((float(m) * c for m, c in zip(row[1:], v[1:])), float(row[0]) * v[0]).alias(n) for row, n in zip(axes, "xyz")])


def distance_curves(cells: DataFrame, targets: DataFrame, radii: list[float]) -> DataFrame:
    """Conditional density over radii along each target's line of sight: targets' columns, r, pdf."""
    hit = locate(targets, cells.select("uniq", "distmu", "distsigma", "distnorm"))
    r = F.explode(F.array(*[F.lit(float(x)) for x in radii])).alias("r")
    return hit.select("*", r).withColumn("pdf", D.conditional_pdf("r", "distmu", "distsigma", "distnorm")).drop("p29", "distmu", "distsigma", "distnorm")


