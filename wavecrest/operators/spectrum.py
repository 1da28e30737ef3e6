"""Spectra of recordings and the metrics of a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.functions import spectral as S
from wavecrest.functions.signal import welch_psd


def spectra(recordings: DataFrame, sfreq: float, nperseg: int = 1024, noverlap: int | None = None, window: str = "hann") -> DataFrame:
    """``recordings`` with freq and p instead of signal; narrow, so it runs where the signals lie."""
    got = recordings.withColumn("_s", welch_psd(F.col("signal"), sfreq, nperseg, noverlap, window))
    return got.select(*[c for c in recordings.columns if c != "signal"], "_s.freq", "_s.p")


def band_powers(psd: DataFrame, relative: bool = False, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row for each band; bands share their common edges."""
    form = S.relative_power if relative else S.band_power
    each = [F.struct(F.lit(b).alias("band"), form(F.col("freq"), F.col("p"), lo, hi).alias("power")) for b, (lo, hi) in (bands or S.BANDS).items()]
    keys = [c for c in psd.columns if c not in ("freq", "p")]
    return psd.select(*keys, F.explode(F.array(*each)).alias("_b")).select(*keys, "_b.band", "_b.power")


def asymmetry(psd: DataFrame, left: str = "F3", right: str = "F4", lo: float = 8.0, hi: float = 13.0, db: bool = False, by: tuple[str, ...] = ("subject", "task")) -> DataFrame:
    """(``by``, faa); null where a channel is missing. Only two channels' powers are shuffled."""
    power = psd.where(F.col("channel").isin(left, right)).select(*by, "channel", S.trapezoid(S.within(F.col("freq"), F.col("p"), lo, hi)).alias("a"))
    sides = power.groupBy(*by).agg(*[F.max(F.when(F.col("channel") == c, F.col("a"))).alias(n) for c, n in ((left, "l"), (right, "r"))])
    found = sides.select(*by, S.asymmetry(F.col("l"), F.col("r"), db).alias("faa"))
    return psd.select(*by).distinct().join(found, list(by), "left")


def metrics(psd: DataFrame, alpha: tuple[float, float] = (8.0, 13.0)) -> DataFrame:
    """All metrics of a channel in one row: bands_abs, bands_rel, entropy, moments, sef95, f50, iaf."""
    f, p = F.col("freq"), F.col("p")

    def bands(form):
        return F.create_map(*[x for b, (lo, hi) in S.BANDS.items() for x in (F.lit(b), form(f, p, lo, hi))])

    keys = [c for c in psd.columns if c not in ("freq", "p")]
    return psd.select(
        *keys,
        bands(S.band_power).alias("bands_abs"),
        bands(S.relative_power).alias("bands_rel"),
        S.spectral_entropy(f, p).alias("entropy"),
        S.spectral_moments(f, p).alias("moments"),
        S.spectral_edge(f, p, 0.95).alias("sef95"),
        S.spectral_edge(f, p, 0.5).alias("f50"),
        S.individual_alpha(f, p, *alpha).alias("iaf"),
    )
