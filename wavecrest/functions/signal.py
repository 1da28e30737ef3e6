"""Numpy signal functions for whole arrays, and the Arrow functions built on them."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPECTRUM = "freq array<double>, p array<double>"


def window(name: str, n: int) -> np.ndarray:
    """A periodic window by name."""
    t = 2 * np.pi * np.arange(n) / n
    forms = {"hann": 0.5 - 0.5 * np.cos(t), "hamming": 0.54 - 0.46 * np.cos(t), "blackman": 0.42 - 0.5 * np.cos(t) + 0.08 * np.cos(2 * t), "boxcar": np.ones(n)}
    if name not in forms:
        raise ValueError(f"unknown window {name!r}")
    return forms[name]


def welch(x: np.ndarray, sfreq: float, nperseg: int = 1024, noverlap: int | None = None, name: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density by Welch: segments less their mean, windowed, squared spectra averaged."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(0), np.zeros(0)
    n = min(nperseg, len(x))
    overlap = min(n // 2 if noverlap is None else noverlap, n - 1)
    w = window(name, n)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - overlap]
    spectra = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2
    p = spectra.mean(axis=0) / (sfreq * (w * w).sum())
    p[1 : len(p) - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n, 1 / sfreq), p


def linear_detrend(x: np.ndarray) -> np.ndarray:
    """Each row less its least-squares line."""
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    x = x - x.mean(axis=-1, keepdims=True)
    return x - np.multiply.outer(x @ t / max(float(t @ t), 1e-300), t)


def butter_bandpass(lo: float, hi: float, sfreq: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth band-pass (five taps) by the bilinear transform of a prewarped prototype."""
    a, b = (2 * sfreq * np.tan(np.pi * f / sfreq) for f in (lo, hi))
    width, centre = b - a, np.sqrt(a * b)
    proto = np.exp(1j * np.pi * np.array([3, 5]) / 4) * width / 2
    poles = np.concatenate((proto + np.sqrt(proto**2 - centre**2), proto - np.sqrt(proto**2 - centre**2)))
    fs2 = 2 * sfreq
    gain = width**2 * np.real(fs2**2 / np.prod(fs2 - poles))
    return gain * np.poly([1, 1, -1, -1]), np.real(np.poly((fs2 + poles) / (fs2 - poles)))


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The filter along the last axis, all rows at once, from state ``z``."""
    out = np.empty_like(x)
    for t in range(x.shape[-1]):
        v = x[..., t]
        y = out[..., t] = b[0] * v + z[0]
        z[:-1] = z[1:] + np.multiply.outer(b[1:-1], v) - np.multiply.outer(a[1:-1], y)
        z[-1] = b[-1] * v - a[-1] * y
    return out


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of each row, ends reflected oddly over 3 taps' lengths."""
    x = np.atleast_2d(np.asarray(x, float))
    pad = min(3 * len(b), x.shape[-1] - 1)
    if pad > 0:
        x = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), axis=1)
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[np.arange(n - 1), np.arange(1, n)] = 1
    rest = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])
    y = _run(b, a, x, np.multiply.outer(rest, x[:, 0]))[:, ::-1]
    y = _run(b, a, y, np.multiply.outer(rest, y[:, 0]))[:, ::-1]
    return y[:, pad : y.shape[1] - pad] if pad > 0 else y


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of each row, over its full length."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * h, axis=-1)


@functools.lru_cache(maxsize=8)
def slepian(n: int, half_bandwidth: float = 4.0, least: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """(tapers, concentrations): the discrete prolate spheroidal sequences of ``n`` samples and half-bandwidth ``half_bandwidth`` / n, with unit energy.

    They are the eigenvectors, largest eigenvalue first, of a symmetric tridiagonal matrix that commutes with the concentration operator; twice the half-bandwidth less one of them count, and of these
    those with a share of more than ``least`` of their energy within the band, or the first if none has.
    """
    t, half_bandwidth = np.arange(n), min(half_bandwidth, n / 2)
    matrix = np.diag(((n - 1) / 2 - t) ** 2 * np.cos(2 * np.pi * half_bandwidth / n))
    side = t[1:] * (n - t[1:]) / 2
    matrix[t[1:], t[:-1]] = matrix[t[:-1], t[1:]] = side
    k = min(n, max(1, int(2 * half_bandwidth) - 1))
    tapers = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T
    kernel = 2 * half_bandwidth / n * np.sinc(2 * half_bandwidth / n * (t[:, None] - t))
    share = np.einsum("ks,st,kt->k", tapers, kernel, tapers, optimize=True)
    kept = share > least
    kept[0] |= not kept.any()
    return tapers[kept], share[kept]


def savgol_weights(width: int = 11, degree: int = 3) -> np.ndarray:
    """Row r holds what the values of a window count for its smoothed r-th value: the projection onto polynomials of the degree."""
    powers = np.vander(np.arange(width) - width // 2, degree + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def savgol(y: np.ndarray, width: int = 11, degree: int = 3) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends take the polynomial of the first and last window."""
    weights, half = savgol_weights(width, degree), width // 2
    out = np.convolve(y, weights[half][::-1], "same")
    out[:half] = (weights @ y[:width])[:half]
    out[-half:] = (weights @ y[-width:])[-half:]
    return out


def welch_psd(signal: Column, sfreq: float, nperseg: int = 1024, noverlap: int | None = None, name: str = "hann") -> Column:
    """struct(freq, p) of an array column, one Arrow batch at a time; null for a null signal."""

    @F.pandas_udf(SPECTRUM)
    def run(xs: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None else welch(x, sfreq, nperseg, noverlap, name) for x in xs]
        return pd.DataFrame({"freq": [g[0] for g in got], "p": [g[1] for g in got]})

    return run(signal)
