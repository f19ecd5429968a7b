"""GPS seconds, UTC and MJD as Column expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .index import _col

#: GPS second from which each leap second since 1980 is counted.  Fixed values (published table).
LEAP_SECONDS = (
    46828800, 78364801, 109900802, 173059203, 252028804, 315187205, 346723206, 393984007, 425520008,
    457056009, 504489610, 551750411, 599184012, 820108813, 914803214, 1025136015, 1119744016, 1167264017,
)
EPOCH = 315964800  # Unix second of 1980-01-06


def _leaps(gps: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in LEAP_SECONDS]), lambda x: gps >= x))


def gps_to_unix_micros(gps) -> Column:
    """UTC microseconds of the Unix clock."""
    gps = _col(gps).cast("double")
    return F.round((gps + EPOCH - _leaps(gps)) * 1e6).cast("long")


def gps_to_iso8601(gps) -> Column:
    """UTC with six digits, e.g. 2015-09-14T09:50:45.391000 for 1126259462.391."""
    micros = gps_to_unix_micros(gps)
    seconds = F.floor(micros / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    left = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02d.%06d", F.floor(left / 3600).cast("int"), F.floor(left % 3600 / 60).cast("int"), (left % 60).cast("int"), F.pmod(micros, F.lit(1_000_000)).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), clock)


def iso8601_to_gps(text) -> Column:
    """The inverse; a final Z and up to nine digits are read."""
    text = F.regexp_replace(_col(text), "Z$", "")
    seconds = F.datediff(F.substring(text, 1, 10).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    clock = F.regexp_extract(text, r"T(\d+):(\d+):([\d.]+)", 1).cast("long") * 3600 + F.regexp_extract(text, r"T(\d+):(\d+):([\d.]+)", 2).cast("long") * 60
    unix = (seconds + clock - EPOCH).cast("double") + F.regexp_extract(text, r"T(\d+):(\d+):([\d.]+)", 3).cast("double")
    table = F.array(*[F.lit(x - k) for k, x in enumerate(LEAP_SECONDS)])  # on the clock without leap seconds
    return unix + F.size(F.filter(table, lambda x: unix >= x))


def gps_to_mjd(gps) -> Column:
    """UTC modified Julian day."""
    return F.lit(40587.0) + gps_to_unix_micros(gps).cast("double") / 86400e6


def instruments_to_text(names) -> Column:
    """Sorted, comma-separated."""
    return F.array_join(F.array_sort(F.array_distinct(_col(names))), ",")


def instruments_from_text(text) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(_col(text), ","), lambda x: F.trim(x)), lambda x: x != "")))


def normalize_objid(objid) -> Column:
    """An integer, or the integer at the end of an identifier like table:column:12, as text; else the text."""
    text = _col(objid).cast("string")
    tail = F.regexp_extract(text, r"^\w+:\w+:(\d+)$", 1)
    return F.when(text.try_cast("long").isNotNull(), text.try_cast("long").cast("string")).when(tail != "", tail).otherwise(text)


def iso8601_of(gps: float) -> str:
    """A number of GPS seconds as UTC text with six digits."""
    micros = round((gps + EPOCH - sum(gps >= x for x in LEAP_SECONDS)) * 1e6)
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=micros)).strftime("%Y-%m-%dT%H:%M:%S.%f")


def gps_of(text: str) -> float:
    """The inverse, for one text."""
    day, _, rest = text.strip().removesuffix("Z").partition(".")
    unix = (datetime.datetime.strptime(day, "%Y-%m-%dT%H:%M:%S") - datetime.datetime(1970, 1, 1)).total_seconds()
    t = unix - EPOCH
    return t + sum(t >= x - k for k, x in enumerate(LEAP_SECONDS)) + (float(f"0.{rest}") if rest else 0.0)


def mjd_of(gps: float) -> float:
    return 40587 + round((gps + EPOCH - sum(gps >= x for x in LEAP_SECONDS)) * 1e6) / 86400e6
