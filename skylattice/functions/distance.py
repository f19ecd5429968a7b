"""The distance ansatz of a pixel: density norm * r^2 * N(r; mu, sigma) along a line of sight.

A pixel without distance has (mu, sigma, norm) = (inf, 1, 0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .index import _col
from .special import SQRT2PI, mills_hazard, normal_between, normal_pdf, upper_tail
from .types import vectorized


def conditional_pdf(r, mu, sigma, norm) -> Column:
    """Density at r; 0 where mu isn't finite or r <= 0.  A plain Column."""
    r, mu, sigma, norm = map(_col, (r, mu, sigma, norm))
    z = (r - mu) / sigma
    density = norm * r * r * F.exp(-0.5 * z * z) / (sigma * SQRT2PI)
    fine = (r > 0) & ~F.isnan(mu) & (F.abs(mu) != float("inf"))
    return F.when(fine, density).otherwise(F.lit(0.0))


def pdf(r, mu, sigma, norm):
    r, mu, sigma, norm = np.broadcast_arrays(*(np.asarray(v, float) for v in (r, mu, sigma, norm)))
    fine = np.isfinite(mu) & (r > 0)
    with np.errstate(invalid="ignore", over="ignore"):
        z = (r - np.where(fine, mu, 0)) / sigma
        return np.where(fine, norm * r**2 * normal_pdf(z) / sigma, 0.0)


def cdf(r, mu, sigma, norm):
    """Integral of the density from 0 to r, in closed form."""
    r, mu, sigma, norm = np.broadcast_arrays(*(np.asarray(v, float) for v in (r, mu, sigma, norm)))
    fine = np.isfinite(mu) & (r > 0)
    m, s = np.where(fine, mu, 0), np.where(fine, sigma, 1)
    low = -m / s
    finite = np.isfinite(r)
    x = np.where(finite & fine, r, 0)
    high = np.where(finite, (x - m) / s, np.inf)
    with np.errstate(invalid="ignore"):
        edge = np.where(finite, (x + m) * np.exp(-0.5 * np.where(finite, high, 0) ** 2), 0)
        total = (m**2 + s**2) * normal_between(low, high) + s / SQRT2PI * (m * np.exp(-0.5 * low**2) - edge)
        return np.where(fine, np.clip(norm * total, 0, None), 0.0)


def _ratios(z):
    """(x2, x3, x4): scaled 2nd, 3rd and 4th moments of the truncated normal."""
    h = mills_hazard(z)
    return z**2 + 1 + z * h, z * (z**2 + 3) + (z**2 + 2) * h, z**2 * (z**2 + 6) + 3 + z * (z**2 + 5) * h


def parameters_to_moments(mu, sigma):
    """(mean, std, norm); (inf, 1, 0) out of the domain."""
    mu, sigma = np.broadcast_arrays(np.asarray(mu, float), np.asarray(sigma, float))
    fine = np.isfinite(mu) & np.isfinite(sigma) & (sigma > 0)
    s = np.where(fine, sigma, 1)
    z = np.where(fine, mu, 0) / s
    x2, x3, x4 = _ratios(z)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = s * x3 / x2
        std = mean * np.sqrt(x4 * x2 / x3**2 - 1)
        norm = 1 / (s**2 * x2 * upper_tail(-z))
    fine &= np.isfinite(mean) & np.isfinite(std)
    return np.where(fine, mean, np.inf), np.where(fine, std, 1.0), np.where(fine, norm, 0.0)


def moments_to_parameters(mean, std):
    """(mu, sigma, norm): the inverse, by bracketed Newton steps; (inf, 1, 0) where mean / std is too small."""
    mean, std = np.broadcast_arrays(np.asarray(mean, float), np.asarray(std, float))
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = mean / std
    fine = np.isfinite(mean) & np.isfinite(std) & np.isfinite(ratio) & (ratio >= np.sqrt(3) + 0.01) & (std > 0)
    target = 1 / np.where(fine, ratio, 5.0) ** 2 + 1

    def excess(z):
        x2, x3, x4 = _ratios(z)
        return x4 * x2 / x3**2 - target

    # the relative spread falls as z rises
    low, high = np.full(target.shape, -40.0), np.where(fine, np.maximum(10.0, ratio * 1.5), 10.0)
    z = (low + high) / 2
    value = excess(z)
    for _ in range(80):
        low, high = np.where(value > 0, z, low), np.where(value > 0, high, z)
        slope = (excess(z + 1e-6) - value) / 1e-6
        with np.errstate(invalid="ignore", divide="ignore"):
            step = z - value / slope
        z_new = np.where(np.isfinite(step) & (step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(z_new - z) <= 1e-14 * (1 + np.abs(z))):
            z = z_new
            break
        z = z_new
        value = excess(z)
    x2, x3, _ = _ratios(z)
    sigma = np.where(fine, mean, 1.0) * x2 / x3
    norm = 1 / (sigma**2 * x2 * upper_tail(-z))
    return np.where(fine, sigma * z, np.inf), np.where(fine, sigma, 1.0), np.where(fine, norm, 0.0)


def ppf(p, mu, sigma, norm):
    """Distance below which a share p of the density lies: 0 at p <= 0, inf at p >= 1, NaN for what isn't finite."""
    p, mu, sigma, norm = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, mu, sigma, norm)))
    fine = np.isfinite(p) & np.isfinite(mu) & np.isfinite(sigma) & np.isfinite(norm) & (norm > 0)
    m, s, n = np.where(fine, mu, 10), np.where(fine, sigma, 1), np.where(fine, norm, 0.01)
    low, high = np.zeros(p.shape), np.maximum(m, 0) + 10 * s
    for _ in range(60):
        short = cdf(high, m, s, n) < p
        if not (short & (p < 1)).any():
            break
        high = np.where(short & (p < 1), 2 * high, high)
    for _ in range(100):
        middle = (low + high) / 2
        less = cdf(middle, m, s, n) < p
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return np.where(~fine, np.nan, np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, (low + high) / 2)))


@vectorized("double")
def conditional_cdf(r: pd.Series, mu: pd.Series, sigma: pd.Series, norm: pd.Series) -> pd.Series:
    return pd.Series(cdf(*(x.to_numpy(float) for x in (r, mu, sigma, norm))))


@vectorized("double")
def conditional_ppf(p: pd.Series, mu: pd.Series, sigma: pd.Series, norm: pd.Series) -> pd.Series:
    return pd.Series(ppf(*(x.to_numpy(float) for x in (p, mu, sigma, norm))))


@vectorized("struct<distmean:double,diststd:double,distnorm:double>")
def to_moments(mu: pd.Series, sigma: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("distmean", "diststd", "distnorm"), parameters_to_moments(mu.to_numpy(float), sigma.to_numpy(float)))))


@vectorized("struct<distmu:double,distsigma:double,distnorm:double>")
def to_parameters(mean: pd.Series, std: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("distmu", "distsigma", "distnorm"), moments_to_parameters(mean.to_numpy(float), std.to_numpy(float)))))
