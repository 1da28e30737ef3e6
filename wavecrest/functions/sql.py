"""Arrow functions of scalar and array ones, and their names in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wavecrest.functions.distributions import f_sf, t_sf2, tukey_sf
from wavecrest.functions.signal import SPECTRUM, analytic, butter_bandpass, filtfilt, savgol, welch


def tail(form: Callable[..., float]):
    """An Arrow function of a scalar one, null for a null argument; each different combination of a batch is computed once."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        rows = list(zip(*(c.tolist() for c in columns), strict=True))
        known = {r: None if any(x is None or x != x for x in r) else form(*r) for r in set(rows)}
        return pd.Series([known[r] for r in rows], dtype="float64")

    return run


def tukey_tail(q: float, k: float, df: float) -> float:
    return tukey_sf(q, int(k), df)


def register(spark: SparkSession) -> None:
    """Makes f_sf(f, df1, df2), t_sf(t, df), tukey_sf(q, k, df), welch_psd(signal, sfreq, nperseg), savgol(values) and
    bandpass_analytic(signal, lo, hi, sfreq) usable in SQL; a null argument gives null."""

    @F.pandas_udf(SPECTRUM)
    def welch_psd(signal: pd.Series, sfreq: pd.Series, nperseg: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if x is None else welch(x, float(fs), int(n)) for x, fs, n in zip(signal, sfreq, nperseg, strict=True)]
        return pd.DataFrame(rows, columns=["freq", "p"])

    @F.pandas_udf("re array<double>, im array<double>")
    def bandpass_analytic(signal: pd.Series, lo: pd.Series, hi: pd.Series, sfreq: pd.Series) -> pd.DataFrame:
        rows = []
        for x, a, b, fs in zip(signal, lo, hi, sfreq, strict=True):
            z = None if x is None else analytic(filtfilt(*butter_bandpass(float(a), float(b), float(fs)), np.asarray(x)))[0]
            rows.append((None, None) if z is None else (z.real, z.imag))
        return pd.DataFrame(rows, columns=["re", "im"])

    @F.pandas_udf("array<double>")
    def smooth(values: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or len(x) < 11 else savgol(np.asarray(x, float)) for x in values])

    for name, form in {"f_sf": tail(f_sf), "t_sf": tail(t_sf2), "tukey_sf": tail(tukey_tail), "welch_psd": welch_psd, "bandpass_analytic": bandpass_analytic, "savgol": smooth}.items():
        spark.udf.register(name, form)
