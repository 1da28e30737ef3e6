"""Tail probabilities of the F, t and studentised-range distributions."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def f_sf(f: float, df1: float, df2: float) -> float:
    if not math.isfinite(f):
        return 0.0 if f == math.inf else math.nan
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Both tails of Student's t."""
    return f_sf(t * t, 1, df) if math.isfinite(t) else math.nan


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


_Z = np.linspace(-9, 9, 3601)
_PHI = np.exp(-_Z * _Z / 2) / math.sqrt(2 * math.pi)


_BELOW = _normal_cdf(_Z)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """The chance that the range of k standard normal values is at most w."""
    shifted = np.interp(_Z - w[:, None], _Z, _BELOW, left=0.0)
    return k * np.trapezoid(_PHI * (_BELOW - shifted) ** (k - 1), _Z, axis=1)


def tukey_sf(q: float, k: int, df: float) -> float:
    """The chance that the studentised range of k means exceeds q, by quadrature over the range and the scale."""
    if not math.isfinite(q) or q <= 0:
        return 1.0 if q <= 0 else 0.0
    if df > 1e7:
        return min(1.0, max(0.0, 1 - float(_range_cdf(np.array([q]), k)[0])))
    spread = 8 / math.sqrt(2 * df)
    s = np.linspace(max(1e-4, 1 - spread), 1 + spread, 401)
    log_density = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return min(1.0, max(0.0, 1 - float(np.trapezoid(np.exp(log_density) * _range_cdf(q * s, k), s))))
