"""Column functions over spectra (arrays of frequencies and powers); they stay in the JVM and shuffle nothing."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavecrest.functions.signal import savgol_weights

EPS = 1e-20
#: Bands in Hz, both ends included.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 7.0), "lower_alpha": (8.0, 10.0), "upper_alpha": (10.0, 12.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
TOTAL = (1.0, 45.0)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def within(freq: Column, p: Column, lo: float, hi: float) -> Column:
    """Array of struct(f, p) with lo <= f <= hi."""
    return F.filter(F.zip_with(freq, p, lambda f, v: F.struct(f.alias("f"), v.alias("p"))), lambda x: x["f"].between(lo, hi))


def powers(freq: Column, p: Column, lo: float, hi: float) -> Column:
    return F.transform(within(freq, p, lo, hi), lambda x: x["p"])


def simpson(y: Column, h: Column) -> Column:
    """Simpson's rule over evenly spaced points; an even number of them ends in a corrected last piece. Null without points."""
    n = F.size(y)
    odd = F.when(n % 2 == 1, n).otherwise(n - 1)
    weight = lambda i: F.when((i == 0) | (i == odd - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    whole = _sum(F.transform(F.slice(y, 1, F.greatest(odd, F.lit(1))), lambda v, i: v * weight(i))) * h / 3.0
    at = lambda k: F.element_at(y, -k)
    last = h * (5.0 / 12.0 * at(1) + 8.0 / 12.0 * at(2) - 1.0 / 12.0 * F.try_element_at(y, F.lit(-3)))
    return F.when(n == 0, F.lit(None).cast("double")).when(n == 1, 0.0).when(n == 2, h / 2.0 * (at(1) + F.try_element_at(y, F.lit(-2)))).when(n % 2 == 1, whole).otherwise(whole + last)


def trapezoid(pairs: Column) -> Column:
    """Area under struct(f, p) points."""
    n = F.size(pairs)
    steps = F.zip_with(F.slice(pairs, 1, F.greatest(n - 1, F.lit(0))), F.slice(pairs, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a["p"] + b["p"]) / 2.0 * (b["f"] - a["f"]))
    return _sum(steps)


def step(freq: Column) -> Column:
    return F.try_element_at(freq, F.lit(2)) - F.try_element_at(freq, F.lit(1))


def band_power(freq: Column, p: Column, lo: float, hi: float) -> Column:
    return simpson(powers(freq, p, lo, hi), step(freq))


def relative_power(freq: Column, p: Column, lo: float, hi: float, total: tuple[float, float] = TOTAL) -> Column:
    return band_power(freq, p, lo, hi) / (band_power(freq, p, *total) + EPS)


def spectral_entropy(freq: Column, p: Column, lo: float = 1.0, hi: float = 45.0, log_base: float | None = None) -> Column:
    """Shannon entropy of the shares of power, in nats or to ``log_base``."""
    ps = powers(freq, p, lo, hi)
    share = F.transform(ps, lambda v: v / (_sum(ps) + EPS))
    nats = -_sum(F.transform(share, lambda v: v * F.ln(v + EPS)))
    return nats / math.log(log_base) if log_base else nats


def spectral_moments(freq: Column, p: Column, lo: float = 1.0, hi: float = 45.0) -> Column:
    """struct(centroid, variance, skewness, kurtosis); kurtosis isn't in excess."""
    x = within(freq, p, lo, hi)
    total = _sum(F.transform(x, lambda v: v["p"]))
    centroid = _sum(F.transform(x, lambda v: v["f"] * v["p"])) / total

    def central(k: int) -> Column:
        return _sum(F.transform(x, lambda v: F.pow(v["f"] - centroid, F.lit(k)) * v["p"]))

    variance = central(2) / total
    return F.struct(
        centroid.alias("centroid"),
        variance.alias("variance"),
        (central(3) / (total * F.pow(F.sqrt(variance) + EPS, F.lit(3)))).alias("skewness"),
        (central(4) / (total * F.pow(variance + EPS, F.lit(2)))).alias("kurtosis"),
    )


def spectral_edge(freq: Column, p: Column, share: float, lo: float = 1.0, hi: float = 45.0) -> Column:
    """The first frequency up to which ``share`` of the power lies; the first of all if none."""
    x = within(freq, p, lo, hi)
    limit = F.lit(share) * (_sum(F.transform(x, lambda v: v["p"])) + EPS)
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("sum"), none.alias("at"))
    found = F.aggregate(x, start, lambda s, v: F.struct((s["sum"] + v["p"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + v["p"] >= limit, v["f"])).alias("at")), lambda s: s["at"])
    return F.coalesce(found, F.try_element_at(x, F.lit(1))["f"])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def smoothed(ps: Column, width: int = 11, degree: int = 3) -> Column:
    """Savitzky-Golay smoothing of an array: fixed weights of each window, of the first and last one at the ends. Arrays shorter than a window stay as they are."""
    weights = F.array(*[F.array(*map(F.lit, row)) for row in savgol_weights(width, degree).tolist()])

    def at(y: Column, w: Column, i: Column) -> Column:
        first = F.greatest(F.least(i - width // 2, F.size(y) - width), F.lit(0))
        return _sum(F.zip_with(F.get(w, i - first), F.slice(y, first + 1, F.lit(width)), lambda a, b: a * b))

    return _bound(F.struct(ps.alias("y"), weights.alias("w")), lambda s: F.when(F.size(s["y"]) < width, s["y"]).otherwise(F.transform(s["y"], lambda _, i: at(s["y"], s["w"], i))))


def _peak(x: Column, floor: float) -> Column:
    """The frequency of the largest power of struct(f, p), as ``peak_frequency`` has it."""
    top = F.array_max(F.transform(x, lambda v: F.struct(v["p"].alias("p"), (-v["f"]).alias("f"))))
    ps = F.array_sort(F.transform(x, lambda v: v["p"]))
    n = F.size(ps)
    median = (F.try_element_at(ps, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ps, F.floor(n / 2).cast("int") + 1)) / 2.0
    return F.when((n > 0) & (top["p"] > median + floor), -top["f"])


def peak_frequency(freq: Column, p: Column, lo: float = 8.0, hi: float = 13.0, floor: float = 1e-12) -> Column:
    """The frequency of the largest power, the first of equal ones; null unless it exceeds the median by ``floor``."""
    return _peak(within(freq, p, lo, hi), floor)


def individual_alpha(freq: Column, p: Column, lo: float = 8.0, hi: float = 13.0, width: int = 11, degree: int = 3, floor: float = 1e-12) -> Column:
    """``peak_frequency`` of smoothed powers, where the band has ``width`` bins at least."""
    x = within(freq, p, lo, hi)
    return _bound(F.zip_with(x, smoothed(F.transform(x, lambda v: v["p"]), width, degree), lambda v, y: F.struct(v["f"].alias("f"), y.alias("p"))), lambda y: _peak(y, floor))


def asymmetry(left: Column, right: Column, db: bool = False) -> Column:
    """ln or decibel difference of two alpha powers."""
    if db:
        return 10 * F.log10(right + EPS) - 10 * F.log10(left + EPS)
    return F.ln(right + EPS) - F.ln(left + EPS)


def power_change(task: Column, base: Column, mode: str = "logratio") -> Column:
    """Task-related power: logratio and log10 are log10 ratios, ln and log natural, db decibels, ratio a relative change."""
    ratio = (task + EPS) / (base + EPS)
    forms = {"logratio": F.log10(ratio), "log10": F.log10(ratio), "ln": F.ln(ratio), "log": F.ln(ratio), "db": 10 * F.log10(ratio), "ratio": (task - base) / (base + EPS)}
    if mode not in forms:
        raise ValueError(f"unknown mode {mode!r}")
    return forms[mode]


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
