"""Task-related power against a baseline, and its means by region, hemisphere and condition."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.functions.spectral import EPS, power_change
from wavecrest.operators.channels import hemisphere, region

#: Names of resting tasks, the first present is the baseline.
BASELINES = ("rest", "baseline", "eyes_closed", "ec", "eo", "eyes_open")
#: Names of each mode, and of the two alpha bands.
MODES = {
    "logratio": ("logratio", "log-ratio", "log_ratio", "lnratio", "ln-ratio"),
    "log": ("log", "ln"),
    "log10": ("log10", "log10-ratio", "log10_ratio"),
    "db": ("db", "decibel"),
    "ratio": ("ratio", "r"),
}
LOWER_KEYS = ("lower", "lower_alpha", "lower-alpha", "alpha_low", "alpha_lower", "8-10", "8_10", "low_alpha", "alpha8_10")
UPPER_KEYS = ("upper", "upper_alpha", "upper-alpha", "alpha_high", "alpha_upper", "10-12", "10_12", "high_alpha", "alpha10_12")


def canonical_mode(mode: str) -> str:
    """The mode that goes by a name, in any case of letters; an unknown name is in lower case itself."""
    low = mode.lower()
    return next((m for m, names in MODES.items() if low in names), low)


def band_keys(bands: list[str], lower: str | None = None, upper: str | None = None) -> tuple[str, str]:
    """The names of the lower and upper alpha band: those given, if both are, else the first of ``bands`` with a known name."""
    if lower and upper:
        return lower, upper
    found = [next((b for b in bands if b.lower() in names), None) for names in (LOWER_KEYS, UPPER_KEYS)]
    if None in found:
        raise ValueError("no lower or upper alpha band; name both")
    return found[0], found[1]


def baselines(powers: DataFrame, baseline: str | None = None) -> DataFrame:
    """(subject, base_task): the given task where a subject has it; without one, the first resting name, else the first of all."""
    tasks = powers.select("subject", "task").distinct()
    if baseline is not None:
        return tasks.where(F.col("task") == baseline).select("subject", F.col("task").alias("base_task"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, BASELINES)), F.col("task")), F.lit(0))
    rank = F.when(rank == 0, 99).otherwise(rank)
    return tasks.groupBy("subject").agg(F.min(F.struct(rank.alias("r"), "task"))["task"].alias("base_task"))


def task_related_power(powers: DataFrame, mode: str = "logratio", baseline: str | None = "1_rest") -> DataFrame:
    """(subject, task, band, ch_idx, trp) of all tasks but the baseline; subjects without it are left out."""
    chosen = powers.join(baselines(powers, baseline), "subject")
    base = chosen.where("task = base_task").select("subject", "band", "ch_idx", F.col("power").alias("base"))
    tasks = chosen.where("task <> base_task")
    return tasks.join(base, ["subject", "band", "ch_idx"]).select("subject", "task", "band", "ch_idx", power_change(F.col("power"), F.col("base"), mode).alias("trp"))


def transform(value: Column, form: str = "none") -> Column:
    """db, log or log10 of values held above a floor, or the values."""
    held = F.greatest(value, F.lit(EPS))
    return {"none": value, "db": 10 * F.log10(held), "log": F.ln(held), "log10": F.log10(held)}[form]


def auto_transform(values: str, axis: str) -> str:
    """The form in which ``values`` of one mode are shown on an axis of another: ratios as the logarithm or decibels the axis is in, all else as it is."""
    axis = canonical_mode(axis)
    if canonical_mode(values) != "ratio" or axis not in ("db", "log", "log10", "logratio"):
        return "none"
    return axis if axis in ("db", "log10") else "log"


def region_means(trp: DataFrame, channels: DataFrame) -> DataFrame:
    """(subject, task, band, hemisphere, region, value): a subject's mean over channels; midline channels have no side and never count."""
    places = channels.select("ch_idx", hemisphere(F.col("channel")).alias("hemisphere"), region(F.col("channel")).alias("region"))
    places = places.where("hemisphere <> 'MID'")
    return trp.join(F.broadcast(places), "ch_idx").groupBy("subject", "task", "band", "hemisphere", "region").agg(F.avg("trp").alias("value"))


def mean_sem(means: DataFrame, form: str = "none") -> DataFrame:
    """Mean and standard error over subjects (0 for one subject) by condition, band, hemisphere and region."""
    keys = [c for c in ("task", "band", "hemisphere", "region") if c in means.columns]
    v = transform(F.col("value"), form)
    n = F.count(v)
    return means.groupBy(*keys).agg(F.avg(v).alias("mean"), F.when(n > 1, F.stddev_samp(v) / F.sqrt(n)).otherwise(0.0).alias("sem"), n.alias("n"))


def collapse(means: DataFrame) -> DataFrame:
    """The mean of the two hemispheres' means, each counting the same."""
    return means.groupBy("subject", "task", "band", "region").agg(F.avg("value").alias("value"))


def parse_merges(specs: list[str], available: list[str]) -> dict[str, list[str]]:
    """``New=a,b*`` names conditions by pattern, in the order given."""
    out: dict[str, list[str]] = {}
    for spec in specs:
        name, eq, patterns = spec.partition("=")
        found = [c for p in patterns.split(",") for c in available if fnmatch.fnmatchcase(c, p.strip())]
        if not eq or not found:
            raise ValueError(f"nothing to merge in {spec!r}")
        out[name.strip()] = list(dict.fromkeys(found))
    return out


def merge_conditions(means: DataFrame, merges: dict[str, list[str]], keep_others: bool = True) -> DataFrame:
    """Conditions under one name: each subject's mean over them; others are kept as they are."""
    rows = [(n, t) for n, ts in merges.items() for t in ts]
    pairs = F.broadcast(means.sparkSession.createDataFrame(rows, "merged string, task string"))
    keys = [c for c in means.columns if c not in ("task", "value")]
    merged = means.join(pairs, "task").groupBy(F.col("merged").alias("task"), *keys).agg(F.avg("value").alias("value"))
    return merged.unionByName(means.join(pairs, "task", "left_anti")) if keep_others else merged


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")


def exclude_conditions(means: DataFrame, patterns: list[str]) -> DataFrame:
    for p in patterns:
        means = means.where(~F.col("task").rlike("^" + _glob(p)))
    return means
