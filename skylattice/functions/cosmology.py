"""Distances and volumes of a flat universe, by quadrature; vectorised and tabulated once."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd

from .types import vectorized

#: Parameters of the Planck 2015 cosmology: Hubble constant in km/s/Mpc, matter, radiation with neutrinos.  Fixed values.
H0, OMEGA_M, OMEGA_R = 67.74, 0.3075, 9.18e-5
C = 299792.458  # km/s
OMEGA_L = 1 - OMEGA_M - OMEGA_R


def efunc(z):
    z = np.asarray(z, float)
    return np.sqrt(OMEGA_M * (1 + z) ** 3 + OMEGA_R * (1 + z) ** 4 + OMEGA_L)


@functools.cache
def _table():
    """(ln(1 + z), comoving distance) on a fine grid up to z = 1000, by Simpson's rule."""
    u = np.linspace(0, np.log(1001), 20001)
    f = np.exp(u) / efunc(np.expm1(u))
    middle = (u[1:] + u[:-1]) / 2
    g = np.exp(middle) / efunc(np.expm1(middle))
    step = (u[1] - u[0]) / 6 * (f[:-1] + 4 * g + f[1:])
    return u, np.concatenate([[0], np.cumsum(step)]) * C / H0


def comoving_distance(z):
    u, d = _table()
    x = np.log1p(np.asarray(z, float))
    k = np.clip((x / u[1]).astype(int), 0, len(u) - 2)
    h = x - u[k]
    slope = C / H0 * np.exp(u) / efunc(np.expm1(u))
    # cubic from values and slopes at both ends
    t = h / u[1]
    a, b = slope[k] * u[1], slope[k + 1] * u[1]
    return d[k] + t * a + t * t * (3 * (d[k + 1] - d[k]) - 2 * a - b) + t**3 * (a + b - 2 * (d[k + 1] - d[k]))


def luminosity_distance(z):
    return (1 + np.asarray(z, float)) * comoving_distance(z)


def ddl_dz(z):
    """Derivative of the luminosity distance."""
    z = np.asarray(z, float)
    return comoving_distance(z) + (1 + z) * C / H0 / efunc(z)


def dvc_dvl(z):
    """Ratio of comoving volume to the volume in luminosity distance, per redshift."""
    z = np.asarray(z, float)
    return (C / H0 / efunc(z)) * comoving_distance(z) ** 2 / (ddl_dz(z) * luminosity_distance(z) ** 2) if np.all(z > 0) else np.where(z > 0, (C / H0 / efunc(z)) * comoving_distance(np.maximum(z, 1e-12)) ** 2 / (ddl_dz(z) * luminosity_distance(np.maximum(z, 1e-12)) ** 2), 1.0)


def z_for_dl(dl):
    """Redshift of a luminosity distance: bracketed by bisection, finished by Newton steps."""
    dl = np.asarray(dl, float)
    low, high = np.zeros(dl.shape), np.full(dl.shape, 999.0)
    for _ in range(40):
        middle = np.expm1((np.log1p(low) + np.log1p(high)) / 2)
        less = luminosity_distance(middle) < dl
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    z = (low + high) / 2
    for _ in range(3):
        z = np.clip(z - (luminosity_distance(z) - dl) / ddl_dz(z), low, high)
    return z


def dvc_dvl_for_dl(dl):
    return dvc_dvl(np.maximum(z_for_dl(dl), 1e-12))


def log_dvc_dvl(dl, knots: int = 32):
    """log of the ratio by a spline over log distance, linear beyond the last knot."""
    grid, value, slope = _spline(knots)
    x = np.log(np.maximum(np.asarray(dl, float), 1e-300))
    k = np.clip(np.searchsorted(grid, x) - 1, 0, len(grid) - 2)
    h = grid[k + 1] - grid[k]
    t = (x - grid[k]) / h
    a, b, dy = slope[k] * h, slope[k + 1] * h, value[k + 1] - value[k]
    inner = value[k] + t * a + t * t * (3 * dy - 2 * a - b) + t**3 * (a + b - 2 * dy)
    return np.where(x <= grid[0], 0.0, np.where(x >= grid[-1], value[-1] + slope[-1] * (x - grid[-1]), inner))


@functools.cache
def _spline(knots):
    grid = np.linspace(np.log(1.0), np.log(1e6), max(knots, 64))
    value = np.log(dvc_dvl_for_dl(np.exp(grid)))
    slope = np.gradient(value, grid)
    fine = 1e-4
    slope[:] = (np.log(dvc_dvl_for_dl(np.exp(grid + fine))) - np.log(dvc_dvl_for_dl(np.exp(grid - fine)))) / (2 * fine)
    return grid, value, slope


@vectorized("double")
def redshift(dl: pd.Series) -> pd.Series:
    return pd.Series(z_for_dl(dl.to_numpy(float)))


@vectorized("double")
def volume_ratio(dl: pd.Series) -> pd.Series:
    return pd.Series(dvc_dvl_for_dl(dl.to_numpy(float)))
