"""What of a map can be seen from a site: altitudes, air mass, observable probability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import index as ix
from ..functions.angles import condition_secz
from .moments import weighted_quantile

#: Days from the Unix epoch to J2000.
J2000_DAYS = 10957.5


def sidereal(unix: Column) -> Column:
    """Greenwich mean sidereal angle in radians, to the precision of the linear formula."""
    d = unix / 86400.0 - J2000_DAYS
    return F.pmod(F.lit(2 * math.pi) * (F.lit(0.7790572732640) + F.lit(1.00273781191135448) * d), F.lit(2 * math.pi))


def sin_altitude(ra, dec, longitude, latitude, unix) -> Column:
    h = sidereal(unix) + longitude - ra
    return F.sin(latitude) * F.sin(dec) + F.cos(latitude) * F.cos(dec) * F.cos(h)


def sun(unix: Column) -> tuple[Column, Column]:
    """(ra, dec) of the sun, by the low-precision formula of the almanac (about 0.01 degrees)."""
    d = unix / 86400.0 - J2000_DAYS
    g = F.radians(357.529 + 0.98560028 * d)
    q = 280.459 + 0.98564736 * d
    lon = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    e = F.radians(23.439 - 0.00000036 * d)
    return F.atan2(F.cos(e) * F.sin(lon), F.cos(lon)), F.asin(F.sin(e) * F.sin(lon))


def seen(cells: DataFrame, sites: DataFrame, times: DataFrame) -> DataFrame:
    m = cells.withColumn("_a", ix.uniq2ang("uniq")).withColumn("_ra", F.col("_a.phi")).withColumn("_dec", math.pi / 2 - F.col("_a.theta"))
    m = m.withColumn("prob", F.col("probdensity") * ix.uniq2pixarea("uniq"))
    # sites and times are a user's short lists
    all_ = m.crossJoin(F.broadcast(sites)).crossJoin(F.broadcast(times))
    return all_.withColumn("_alt", sin_altitude(F.col("_ra"), F.col("_dec"), F.radians("longitude"), F.radians("latitude"), F.col("unix")))


def observability(cells: DataFrame, sites: DataFrame, times: DataFrame, max_airmass: float = 2.5, twilight: float = -18.0, keys: list[str] = []) -> DataFrame:
    """(keys, site, unix, fraction): probability above the air mass, 0 unless the sun is below ``twilight`` degrees.

    ``sites`` has (site, longitude, latitude) in degrees, ``times`` has ``unix``.
    """
    cells = seen(cells, sites, times)
    ra, dec = sun(F.col("unix"))
    dark = sin_altitude(ra, dec, F.radians("longitude"), F.radians("latitude"), F.col("unix")) < math.sin(math.radians(twilight))
    fine = (condition_secz(1 / F.col("_alt")) <= max_airmass) & dark
    return cells.groupBy(*keys, "site", "unix").agg((F.sum(F.when(fine, F.col("prob")).otherwise(0.0)) / F.sum("prob")).alias("fraction"))


def airmass(cells: DataFrame, sites: DataFrame, times: DataFrame, percentiles: list[float] = [5.0, 50.0, 95.0], keys: list[str] = []) -> DataFrame:
    """(keys, site, unix, q, airmass): probability-weighted percentiles of the air mass; below the horizon it is infinite."""
    rows = seen(cells, sites, times).withColumn("airmass", condition_secz(1 / F.col("_alt")))
    return weighted_quantile(rows, "airmass", "prob", [p / 100 for p in percentiles], [*keys, "site", "unix"], "lower")
