"""Results and failures of a grouped function from one pass."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

FAILURES = "subject string, task string, stage string, error string"


class Outcome(NamedTuple):
    """What a function gave for the groups it worked for, and (subject, task, stage, error) of those it failed for.

    Both are views of ``both``, one pass over the groups; whoever uses both sides should store ``both`` first.
    """

    both: DataFrame
    stage: str

    @property
    def good(self) -> DataFrame:
        return self.both.where("_error is null").drop("_error")

    @property
    def failed(self) -> DataFrame:
        keys = [F.col(c).cast("string").alias(c) if c in self.both.columns else F.lit(None).cast("string").alias(c) for c in ("subject", "task")]
        return self.both.where("_error is not null").select(*keys, F.lit(self.stage).alias("stage"), F.col("_error").alias("error"))


def told(error: Exception) -> str:
    """An error's kind and words."""
    return f"{type(error).__name__}: {error}"


def guarded(groups: GroupedData, keys: list[str], run: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, stage: str) -> Outcome:
    """``groups.applyInPandas(run, schema)``, except that a group for which ``run`` raises has its keys and the error in one row instead.

    An error of the function is data; a lost worker, memory or the like still fails the task, which Spark repeats.
    """

    names = [f.split()[0] for f in schema.split(", ")]

    def tagged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(key, pdf).assign(_error=None)
        except Exception as e:  # noqa: BLE001 - whatever a bad recording does is told, not lost
            return _failure(names, dict(zip(keys, key, strict=True)), told(e))

    return Outcome(groups.applyInPandas(tagged, f"{schema}, _error string"), stage)


def _failure(names: list[str], known: dict, error: str) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(names) | known | {"_error": error}], dtype=object)


def signals(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A recording's channels in order, as long as the shortest; a missing or empty one is an error that names it."""
    pdf = pdf.sort_values("ch_idx")
    for channel, x in zip(pdf["ch_idx"], pdf["signal"], strict=True):
        if x is None or not len(x):
            raise ValueError(f"channel {channel} has {'no signal' if x is None else 'no samples'}")
    n = min(map(len, pdf["signal"]))
    return pdf["ch_idx"].to_numpy(), np.array([np.asarray(x, float)[:n] for x in pdf["signal"]])


def status(recordings: DataFrame, failures: DataFrame) -> DataFrame:
    """(subject, task, ok, error): every recording, with its failures one after another; a file that couldn't be read has its subject alone."""
    told_all = failures.groupBy("subject", "task").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "stage", "error"))), "; ").alias("error"))
    known = recordings.select(F.col("subject").cast("string").alias("subject"), F.col("task").cast("string").alias("task")).distinct()
    keys = known.union(told_all.select("subject", "task")).distinct()
    other = told_all.select(F.col("subject").alias("_s"), F.col("task").alias("_t"), "error")
    found = keys.join(other, F.col("subject").eqNullSafe(F.col("_s")) & F.col("task").eqNullSafe(F.col("_t")), "left")
    return found.select("subject", "task", F.col("error").isNull().alias("ok"), "error")
