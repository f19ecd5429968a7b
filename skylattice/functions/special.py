"""Special functions on NumPy arrays."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])
SQRT2, SQRT2PI = math.sqrt(2), math.sqrt(2 * math.pi)


def erfc(x):
    return _erfc(np.asarray(x, float))


def normal_pdf(x):
    return np.exp(-0.5 * np.asarray(x, float) ** 2) / SQRT2PI


def normal_cdf(x):
    return 0.5 * erfc(-np.asarray(x, float) / SQRT2)


def upper_tail(z):
    """P(Z > z) of the unit normal."""
    return 0.5 * erfc(np.asarray(z, float) / SQRT2)


def mills_hazard(z):
    """phi(-z) / P(Z > -z): the density over the tail to the right of -z; a continued fraction in the far tail."""
    z = np.asarray(z, float)
    far = z < -8
    y = np.where(far, -z, 8.0)
    fraction = np.zeros_like(y)
    for k in range(60, 0, -1):
        fraction = k / (y + fraction)
    near = np.where(far, 0.0, z)
    return np.where(far, y + fraction, normal_pdf(near) / upper_tail(-near))


def normal_between(a, b):
    """Phi(b) - Phi(a), from the side on which both are small."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    right = a > 0
    return np.where(right, upper_tail(a) - upper_tail(b), normal_cdf(b) - normal_cdf(a))


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def beta_quantile(p, a, b):
    """Inverse of ``incomplete_beta`` by bisection."""
    p, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        middle = (low + high) / 2
        less = incomplete_beta(a, b, middle) < p
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return (low + high) / 2


#: Polynomials for the modified Bessel function I0, below and above 3.75.  Fixed values (Abramowitz and Stegun 9.8.1, 9.8.2).
_I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
_I0_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)


def log_bessel_i0e(x):
    """log(exp(-x) I0(x)) for x >= 0, to about 2e-7."""
    x = np.asarray(x, float)
    near = np.minimum(x, 3.75)
    far = np.maximum(x, 3.75)
    small = np.polynomial.polynomial.polyval((near / 3.75) ** 2, _I0_SMALL)
    large = np.polynomial.polynomial.polyval(3.75 / far, _I0_LARGE)
    return np.where(x < 3.75, np.log(small) - near, np.log(large) - 0.5 * np.log(far))


def log_sum_exp(x, axis=None):
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - m), axis=axis, keepdims=True)) + m
    return np.squeeze(out, axis=axis) if axis is not None else out.item()
