"""The scalar functions under names of their own in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd

from . import cosmology, distance, index, signal
from .text import format_area
from .tree import TreeLeaves
from .types import vectorized


def _numbers(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(float) for c in columns]


@vectorized("double")
def conditional_pdf(r: pd.Series, mu: pd.Series, sigma: pd.Series, norm: pd.Series) -> pd.Series:
    return pd.Series(distance.pdf(*_numbers(r, mu, sigma, norm)))


@vectorized("long")
def nest2uniq(order: pd.Series, ipix: pd.Series) -> pd.Series:
    o, i = order.to_numpy(np.int64), ipix.to_numpy(np.int64)
    return pd.Series(np.where(i >= 0, i + (np.int64(1) << (2 * (np.maximum(o, 0) + 1))), -1))


def _order(uniq: np.ndarray) -> np.ndarray:
    """By binary digits, in integers: a logarithm of large numbers rounds up."""
    out = np.full(len(uniq), -1, np.int32)
    for k in range(30):
        out += uniq >= np.int64(4) ** (k + 1)
    return out


@vectorized("int")
def uniq2order(uniq: pd.Series) -> pd.Series:
    return pd.Series(_order(uniq.to_numpy(np.int64)))


@vectorized("struct<order:int,ipix:long>")
def uniq2nest(uniq: pd.Series) -> pd.DataFrame:
    u = uniq.to_numpy(np.int64)
    o = _order(u)
    return pd.DataFrame({"order": o, "ipix": np.where(o >= 0, u - (np.int64(1) << (2 * (np.maximum(o, 0).astype(np.int64) + 1))), -1)})


@vectorized("double")
def uniq2pixarea(uniq: pd.Series) -> pd.Series:
    o = _order(uniq.to_numpy(np.int64))
    return pd.Series(np.where(o >= 0, np.pi / 3 * 0.25 ** o.astype(float), np.nan))


@vectorized("struct<re:double,im:double>")
def antenna_factor(response: pd.Series, ra: pd.Series, dec: pd.Series, gmst: pd.Series) -> pd.DataFrame:
    d = np.stack([np.reshape(x, (3, 3)) for x in response]) if len(response) else np.zeros((0, 3, 3))
    f = signal.antenna_factor(d, *_numbers(ra, dec, gmst))
    return pd.DataFrame({"re": f.real, "im": f.imag})


@vectorized("struct<re:double,im:double>")
def signal_amplitude(f_re: pd.Series, f_im: pd.Series, twopsi: pd.Series, u: pd.Series) -> pd.DataFrame:
    a, b, t, v = _numbers(f_re, f_im, twopsi, u)
    z = signal.signal_amplitude(a + 1j * b, signal.exp_i(t), v)
    return pd.DataFrame({"re": z.real, "im": z.imag})


FUNCTIONS = {
    "sky_conditional_pdf": conditional_pdf, "sky_conditional_cdf": distance.conditional_cdf, "sky_conditional_ppf": distance.conditional_ppf,
    "sky_moments_to_parameters": distance.to_parameters, "sky_parameters_to_moments": distance.to_moments,
    "sky_nest2uniq": nest2uniq, "sky_uniq2nest": uniq2nest, "sky_uniq2order": uniq2order, "sky_uniq2pixarea": uniq2pixarea, "sky_uniq2ang": index.uniq2ang,
    "sky_ang2nest": index.ang2nest, "sky_nest2ring": index.nest2ring, "sky_ring2nest": index.ring2nest, "sky_neighbours": index.neighbours,
    "sky_antenna_factor": antenna_factor, "sky_signal_amplitude": signal_amplitude, "sky_redshift": cosmology.redshift, "sky_volume_ratio": cosmology.volume_ratio, "sky_format_area": format_area,
}


def register(spark) -> list[str]:
    """Register all of them with a session, the table function ``sky_tree_leaves`` too; returns the names of the scalar ones."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("sky_tree_leaves", TreeLeaves)
    return list(FUNCTIONS)
