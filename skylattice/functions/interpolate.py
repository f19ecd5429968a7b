"""Cubic interpolation of regular grids in one and two dimensions, with edges held and gaps bridged."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .signal import catmull_rom
from .types import vectorized


def _between(z0, z1, z2, z3, t):
    """Catmull-Rom between z1 and z2; a straight line where an outer value isn't finite, z1 where an inner one isn't."""
    with np.errstate(invalid="ignore"):
        cubic, line = catmull_rom(z0, z1, z2, z3, t), z1 + (z2 - z1) * t
        return np.where(np.isfinite(z1 + z2), np.where(np.isfinite(z0 + z3), cubic, line), z1)


def _place(x, low, step, n):
    """(indices of four neighbours, share of the way from the second to the third); positions beyond the edges are held there."""
    u = np.clip(np.nan_to_num((np.asarray(x, float) - low) / step, nan=0.0, posinf=n + 2.0, neginf=-3.0), -3.0, n + 2.0)
    k = np.floor(u).astype(int)
    return np.clip(k[..., None] + np.arange(-1, 3), 0, n - 1), u - k


class Cubic:
    """``values`` at low, low + step, ...: a cubic through them."""

    def __init__(self, values, low: float, step: float):
        self.values, self.low, self.step = np.asarray(values, float), float(low), float(step)

    def __call__(self, x):
        at, t = _place(x, self.low, self.step, len(self.values))
        z = self.values[at]
        return np.where(np.isnan(x), np.nan, _between(*np.moveaxis(z, -1, 0), t))


class Bicubic:
    """``values[i, j]`` at (low[0] + i step[0], low[1] + j step[1]): cubics along the second axis, then one along the first."""

    def __init__(self, values, low, step):
        self.values, self.low, self.step = np.asarray(values, float), low, step

    def __call__(self, x, y):
        n, m = self.values.shape
        i, s = _place(x, self.low[0], self.step[0], n)
        j, t = _place(y, self.low[1], self.step[1], m)
        rows = [_between(*np.moveaxis(self.values[i[..., k, None], j], -1, 0), t) for k in range(4)]
        return np.where(np.isnan(x) | np.isnan(y), np.asarray(x, float) + np.asarray(y, float), _between(*rows, s))


def cubic(values, low: float, step: float):
    """A UDF of one Column; the grid is a parameter of the user and goes with the function."""
    f = Cubic(values, low, step)

    @vectorized("double")
    def at(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float)))

    return at


def bicubic(values, low, step):
    """A UDF of two Columns."""
    f = Bicubic(values, low, step)

    @vectorized("double")
    def at(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), y.to_numpy(float)))

    return at
