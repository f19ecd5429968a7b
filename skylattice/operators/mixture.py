"""A Dirichlet-process mixture of Gaussians over the sky, fitted by variational steps in the samples' own frame."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.angles import eigen_frame
from ..functions.special import log_sum_exp
from ..functions.types import vectorized
from .density import k_means, to_vectors, whiten
from .maps import adaptive_grid


def _digamma(x):
    """By the recurrence up to 6 and the asymptotic series behind it."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out = out - np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


class SkyMixture:
    """Density over directions: sticks of a Dirichlet process break the weight among at most ``most`` Gaussians.

    Coordinates are the longitude and the sine of the latitude in the frame of the samples' principal axes; a point is
    also seen from one turn to either side, so that clusters at the edge are whole.  Only clusters that the samples need keep weight.
    """

    def __init__(self, ra, dec, most: int = 20, concentration: float = 1.0, rounds: int = 200, seed: int = 0):
        v = to_vectors(np.asarray(ra, float), np.asarray(dec, float))
        self.frame = eigen_frame(v)[[2, 1, 0]]
        self.frame[2] *= np.sign(np.linalg.det(self.frame))
        x = self._own(v)
        n, d = x.shape
        most = min(most, n)
        share = np.eye(most)[k_means(whiten(x)[0], most, seed)]  # begun by clusters, each point in one
        before, centre, pooled = -math.inf, None, None
        for _ in range(rounds):
            held = share.sum(axis=0)
            order = np.argsort(-held, kind="stable")  # the larger clusters break the stick first
            share, held = share[:, order], held[order]
            a, b = 1 + held, concentration + np.append(np.cumsum(held[::-1])[::-1][1:], 0.0)
            broken, rest = _digamma(a) - _digamma(a + b), _digamma(b) - _digamma(a + b)
            log_weight = broken + np.concatenate([[0], np.cumsum(rest)[:-1]])
            centre = (share.T @ x) / np.maximum(held, 1e-9)[:, None] if centre is None else centre[order]
            # each point by its image nearest to the centre, so that a cluster across the edge is one
            centre = centre + np.einsum("nk,nkd->kd", share, self._off(x, centre)) / np.maximum(held, 1e-9)[:, None]
            self.mean = centre
            off = self._off(x, centre)
            scatter = np.einsum("nk,nki,nkj->kij", share, off, off)
            if pooled is None:  # the spread within clusters, as good as 10 points of each
                pooled = scatter.sum(axis=0) / n + 1e-9 * np.eye(d)
            self.cov = (scatter + 10 * pooled) / (held + 10)[:, None, None]
            log_p = log_weight + self._log_normal(x)
            total = log_sum_exp(log_p, axis=1)
            share = np.exp(log_p - total[:, None])
            if abs(total.sum() - before) < 1e-7 * n:
                break
            before = float(total.sum())
        keep = held > 0.5
        self.mean, self.cov = self.mean[keep], self.cov[keep]
        self.weight = held[keep] / held[keep].sum()

    @staticmethod
    def _off(x, centre):
        off = x[:, None] - centre[None]
        off[..., 0] = np.mod(off[..., 0] + np.pi, 2 * np.pi) - np.pi
        return off

    def _own(self, v):
        w = v @ self.frame.T
        return np.stack([np.arctan2(w[:, 1], w[:, 0]), np.clip(w[:, 2], -1, 1)], axis=1)

    def _log_normal(self, x):
        inverse, (_, log_det) = np.linalg.inv(self.cov), np.linalg.slogdet(self.cov)
        best = None
        for turn in (0.0, 2 * np.pi, -2 * np.pi):
            off = self._off(x, self.mean) + np.array([turn, 0.0])
            e = -0.5 * np.einsum("nki,kij,nkj->nk", off, inverse, off)
            best = e if best is None else np.logaddexp(best, e)
        return best - 0.5 * log_det - math.log(2 * np.pi)

    def __call__(self, theta, phi):
        """Density per steradian, up to what of the Gaussians lies beyond the poles."""
        theta, phi = np.asarray(theta, float), np.asarray(phi, float)
        v = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], axis=1)
        return np.exp(log_sum_exp(np.log(self.weight) + self._log_normal(self._own(v)), axis=1))

    def as_map(self, spark, top_order: int = 4, rounds: int = 8) -> DataFrame:
        """(uniq, probdensity), refined where most probability lies."""

        @vectorized("double")
        def at(theta: pd.Series, phi: pd.Series) -> pd.Series:
            return pd.Series(self(theta.to_numpy(float), phi.to_numpy(float)))

        return adaptive_grid(spark, at, top_order, rounds)
