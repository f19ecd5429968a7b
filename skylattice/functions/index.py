"""Pixel-index arithmetic as Column expressions, and the pandas UDFs of the geometry.

The unique number of a cell is ipix + 4^(order + 1).  All of this stays within
whole-stage code generation; only the geometry of pixels runs in NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import healpix
from .types import vectorized


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _power4(order: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (2 * order).cast("int"))


def nest2uniq(order, ipix) -> Column:
    """-1 for a negative pixel."""
    order, ipix = _col(order), _col(ipix).cast("long")
    return F.when(ipix >= 0, ipix + _power4(order + 1)).otherwise(F.lit(-1).cast("long"))


def uniq2order(uniq) -> Column:
    """-1 below 4.  Counted in binary digits: exact for all orders, unlike a logarithm."""
    uniq = _col(uniq).cast("long")
    return F.when(uniq >= 4, F.floor((F.length(F.bin(uniq)) - 1) / 2).cast("int") - 1).otherwise(F.lit(-1))


def uniq2nest(uniq) -> tuple[Column, Column]:
    """(order, ipix); both -1 where the number is no cell."""
    order = uniq2order(uniq)
    return order, F.when(order >= 0, _col(uniq).cast("long") - _power4(order + 1)).otherwise(F.lit(-1).cast("long"))


def uniq2pixarea(uniq) -> Column:
    """Steradians; NaN where the number is no cell."""
    order = uniq2order(uniq)
    return F.when(order >= 0, F.lit(np.pi / 3) * F.pow(F.lit(0.25), order)).otherwise(F.lit(float("nan")))


def ancestor(ipix, levels) -> Column:
    """The cell ``levels`` orders up that holds a nested pixel."""
    return F.call_function("shiftright", _col(ipix).cast("long"), (2 * _col(levels)).cast("int"))


def children(ipix) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: _col(ipix) * 4 + k)


def first_descendant(ipix, levels) -> Column:
    return F.call_function("shiftleft", _col(ipix).cast("long"), (2 * _col(levels)).cast("int"))


def isfinite(x) -> Column:
    x = _col(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


@vectorized("struct<theta:double,phi:double>")
def uniq2ang(uniq: pd.Series) -> pd.DataFrame:
    """Centre of a cell; NaN where the number is no cell."""
    u = uniq.fillna(0).to_numpy(np.int64)
    good = u >= 4
    order = np.where(good, (np.frexp(np.maximum(u, 4).astype(float))[1] - 1) // 2 - 1, 0)
    order = np.where(np.maximum(u, 4) < np.int64(4) ** (order + 1), order - 1, order)  # rounding up to a power
    theta, phi = healpix.pix2ang(order, np.where(good, u - np.int64(4) ** (order + 1), 0))
    return pd.DataFrame({"theta": np.where(good, theta, np.nan), "phi": np.where(good, phi, np.nan)})


@vectorized("long")
def ang2nest(order: pd.Series, theta: pd.Series, phi: pd.Series) -> pd.Series:
    return pd.Series(healpix.ang2pix(order.to_numpy(np.int64), theta.to_numpy(float), phi.to_numpy(float)))


@vectorized("long")
def zphi2nest(order: pd.Series, z: pd.Series, phi: pd.Series) -> pd.Series:
    """The same by the cosine of theta: exact for directions that are given so."""
    return pd.Series(healpix.zphi2pix(order.to_numpy(np.int64), z.to_numpy(float), phi.to_numpy(float)))


@vectorized("struct<x:double,y:double,z:double>")
def nest2vec(order: pd.Series, ipix: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(healpix.pix2vec(order.to_numpy(np.int64), ipix.to_numpy(np.int64)), columns=["x", "y", "z"])


@vectorized("long")
def nest2ring(order: pd.Series, ipix: pd.Series) -> pd.Series:
    return pd.Series(healpix.nest2ring(order.to_numpy(np.int64), ipix.to_numpy(np.int64)))


@vectorized("long")
def ring2nest(order: pd.Series, ipix: pd.Series) -> pd.Series:
    return pd.Series(healpix.ring2nest(order.to_numpy(np.int64), ipix.to_numpy(np.int64)))


@vectorized("array<long>")
def neighbours(order: pd.Series, ipix: pd.Series) -> pd.Series:
    """The 8 neighbours; -1 where there is none."""
    return pd.Series(list(healpix.neighbours(order.to_numpy(np.int64), ipix.to_numpy(np.int64))))


def interpolation(order: int):
    """UDF (theta, phi) -> array of 4 structs (ipix, weight) of bilinear interpolation."""

    @vectorized("array<struct<ipix:long,weight:double>>")
    def weights(theta: pd.Series, phi: pd.Series) -> pd.Series:
        pix, w = healpix.interpolation(order, theta.to_numpy(float), phi.to_numpy(float))
        return pd.Series([[{"ipix": int(a), "weight": float(b)} for a, b in zip(p, q)] for p, q in zip(pix, w)])

    return weights
