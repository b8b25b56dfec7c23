"""The normal distribution on whole arrays, accurate in both tails."""

from __future__ import annotations

import numpy as np

_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)
#: From here on the tail's continued fraction, before it the series around zero.
_TAIL = 3.0


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z - _HALF_LOG_2PI)


def _odd_series(z: np.ndarray) -> np.ndarray:
    """cdf(z) - 1/2 = density(z) * (z + z^3/3 + z^5/(3*5) + ...); 45 terms are exact to rounding for |z| up to 3."""
    term, total = z.copy(), z.copy()
    for n in range(3, 93, 2):
        term = term * z * z / n
        total += term
    return _density(z) * total


def _mills(z: np.ndarray) -> np.ndarray:
    """(1 - cdf(z)) / density(z) for z from 3: 1/(z + 1/(z + 2/(z + 3/(z + ...)))), from the far end."""
    f = z.copy()
    for n in range(80, 0, -1):
        f = z + n / f
    return 1.0 / f


def cdf(z: np.ndarray) -> np.ndarray:
    """The distribution function; nan stays nan."""
    z = np.asarray(z, np.float64)
    out = np.where(np.isnan(z), np.nan, np.where(z > 0, 1.0, 0.0))
    near = np.abs(z) < _TAIL
    out[near] = 0.5 + _odd_series(z[near])
    far = (np.abs(z) >= _TAIL) & (np.abs(z) < 40)
    tail = _density(z[far]) * _mills(np.abs(z[far]))
    out[far] = np.where(z[far] > 0, 1 - tail, tail)
    return out


def log_cdf(z: np.ndarray) -> np.ndarray:
    """Logarithm of the distribution function, also where that underflows."""
    z = np.asarray(z, np.float64)
    out = np.zeros_like(z)
    near, low, high = np.abs(z) < _TAIL, z <= -_TAIL, z >= _TAIL
    out[near] = np.log(0.5 + _odd_series(z[near]))
    out[low] = -0.5 * z[low] ** 2 - _HALF_LOG_2PI + np.log(_mills(-z[low]))
    out[high] = np.log1p(-_density(z[high]) * _mills(z[high]))
    out[np.isnan(z)] = np.nan
    return out


def interval_nll(mu: np.ndarray, log_sigma: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ML1: -log P(lower < X <= upper) of each row, and its derivatives by mu and by log sigma; bounds may be infinite.

    The upper tail is mirrored, so that no difference of two numbers near one cancels. Bounds are capped at 1000.
    """
    sigma = np.exp(log_sigma)
    zu, zl = (np.minimum(upper, 1e3) - mu) / sigma, (np.maximum(lower, -1e3) - mu) / sigma
    flip = zu + zl > 0
    high, low = np.where(flip, -zl, zu), np.where(flip, -zu, zl)
    log_high, log_low = log_cdf(high), log_cdf(low)
    log_p = log_high + np.log1p(-np.exp(np.minimum(log_low - log_high, -1e-7)))
    # densities over the probability; a bound without a density adds nothing
    up, down = (np.exp(np.minimum(-0.5 * z * z - _HALF_LOG_2PI - log_p, 700)) for z in (zu, zl))
    return -log_p, (up - down) / sigma, zu * up - zl * down
