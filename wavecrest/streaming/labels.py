"""Label sequences as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(subject, label, start, end, n): sessions of one label with no longer pause than ``gap``; ``late`` bounds the state.

    ``events`` is a stream or a table of subject, label, ts.
    """
    held = events.withWatermark("ts", late)
    found = held.groupBy(F.session_window("ts", gap).alias("w"), "subject", "label").agg(F.count("*").alias("n"))
    return found.select("subject", "label", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
