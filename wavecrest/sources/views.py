"""Signals made of the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.operators.ranges import numbered
from wavecrest.sources.recordings import montage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """126 vectors are a subject of two tasks with 63 channels of 64 samples; subjects with fewer are left out."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 126").alias("subject"), F.expr("vec_id % 126").cast("int").alias("k"), F.col("embedding").cast("array<double>").alias("signal"))
    whole = rows.groupBy("subject").count().where("count = 126").select("subject")
    named = rows.join(whole, "subject", "left_semi").select(
        "subject", F.when(F.col("k") < 63, "1_rest").otherwise("1_idea generation").alias("task"), (F.col("k") % 63).alias("ch_idx"), "signal"
    )
    return named.join(F.broadcast(montage(spark)), "ch_idx").select("subject", "task", "ch_idx", "channel", "signal")


#: Users whose events make one subject.
BUCKET_USERS = 50


def ordered_means(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """(by, x): the mean of each group's values, added up one after another in ``order`` as SQL on one thread does it; no other order rounds alike.

    The sum runs along a window, which spills, so no group has to fit into memory.
    """
    along = Window.partitionBy(*by).orderBy(*order, value)
    sums = rows.where(F.col(value).isNotNull()).select(*by, F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_sum"), F.row_number().over(along).alias("_n"))
    return sums.groupBy(*by).agg((F.max_by("_sum", "_n") / F.max("_n")).alias("x"))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, task, ch, t, h, x): mean event value by bucket of users, type and hour of 720, gaps 0; tasks are phases of 240 hours."""
    bucket = F.expr(f"user_id div {BUCKET_USERS}").alias("subject")
    ev = table(spark, sf_dir, "events").select(bucket, "event_id", "event_type", ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).alias("h"), "value").where("h between 0 and 719")
    means = ordered_means(ev, ["subject", "event_type", "h"], "value", ["event_id"])
    grid = ev.select("subject", "event_type").distinct().select("subject", "event_type", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("h"))
    full = grid.join(means, ["subject", "event_type", "h"], "left").select("subject", "event_type", "h", F.coalesce("x", F.lit(0.0)).alias("x"))
    return full.select("subject", (F.col("h") / 240).cast("int").cast("string").alias("task"), F.col("event_type").alias("ch"), (F.col("h") % 240).alias("t"), "h", "x")


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, label): a user's event types in order of event_id."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "event_id", F.col("event_type").alias("label"))
    return numbered(events, ["subject"], F.col("event_id"), ["event_id"], "t").select("subject", F.col("t").cast("long").alias("t"), "label")
