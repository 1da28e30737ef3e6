"""Channel operators: hemispheres, regions, and the 64th channel made from its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The channels (numbered from 0 of 63) whose mean is Cz, and its place among 64.
CZ_NEIGHBOURS = (6, 38, 27, 39, 56, 11, 52, 22)
CZ = 23
#: Regions by the first letters of a label.
REGIONS = {"F": "frontal", "AF": "frontal", "C": "central", "T": "temporal", "P": "parietal", "O": "occipital"}


def hemisphere(label: Column) -> Column:
    """LH for odd, RH for even last digits, MID for labels that end in z or have no number."""
    number = F.regexp_extract(label, r"(\d+)$", 1)
    return F.when(F.lower(label).endswith("z") | (number == ""), "MID").when(number.cast("int") % 2 == 1, "LH").otherwise("RH")


def region(label: Column) -> Column:
    """The region of a label's first letters; central for others."""
    low = F.upper(label)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, name in REGIONS.items():
        out = out.when(low.startswith(prefix), name)
    return out.otherwise("central")


def interpolate_cz(recordings: DataFrame) -> DataFrame:
    """63 to 64 channels of (subject, task, ch_idx, signal): later channels move up, Cz is its neighbours' mean.

    Only recordings of exactly 63 channels gain one; others pass. Signals stay arrays: no sample becomes a row.
    Neighbours of unlike length give their mean where all have a sample.
    """
    counts = recordings.groupBy("subject", "task").agg(F.countDistinct("ch_idx").alias("_n"))
    whole = counts.where(F.col("_n") == 63).select("subject", "task", F.lit(1).alias("_up"))
    moved = recordings.join(whole, ["subject", "task"], "left")
    moved = moved.select("subject", "task", (F.col("ch_idx") + F.when(F.col("ch_idx") >= CZ, F.coalesce("_up", F.lit(0))).otherwise(0)).cast("int").alias("ch_idx"), "signal")
    near = recordings.where(F.col("ch_idx").isin(*CZ_NEIGHBOURS)).join(whole, ["subject", "task"]).groupBy("subject", "task").agg(F.sort_array(F.collect_list(F.struct("ch_idx", "signal"))).alias("near"))
    total = F.aggregate(F.slice("near", 2, len(CZ_NEIGHBOURS)), F.col("near")[0]["signal"], lambda acc, x: F.zip_with(acc, x["signal"], lambda a, b: a + b))
    mean = F.filter(F.transform(total, lambda x: x / len(CZ_NEIGHBOURS)), lambda x: x.isNotNull())
    return moved.unionByName(near.select("subject", "task", F.lit(CZ).alias("ch_idx"), mean.alias("signal")))


def verify_cz(before: DataFrame, after: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(subject, task, block, largest_difference, ok) of recordings for the channels before Cz, Cz itself, and those after; a missing channel or sample differs without bound."""
    ch = F.col("ch_idx")
    same = before.select("subject", "task", (ch + (ch >= CZ).cast("int")).alias("ch_idx"), F.col("signal").alias("want"))
    near = before.where(ch.isin(*CZ_NEIGHBOURS)).select("subject", "task", F.posexplode("signal").alias("t", "x")).groupBy("subject", "task", "t").agg(F.avg("x").alias("x"))
    near = near.groupBy("subject", "task").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s")).select("subject", "task", F.lit(CZ).alias("ch_idx"), F.col("s.x").alias("want"))
    block = F.when(ch < CZ, "before").when(ch == CZ, "cz").otherwise("after")
    joined = after.join(same.unionByName(near), ["subject", "task", "ch_idx"], "left")
    apart = F.zip_with("signal", F.coalesce("want", F.array().cast("array<double>")), lambda a, b: F.coalesce(F.abs(a - b), F.lit(float("inf"))))
    worst = joined.groupBy("subject", "task", block.alias("block")).agg(F.max(F.coalesce(F.array_max(apart), F.lit(0.0))).alias("largest_difference"))
    return worst.withColumn("ok", F.col("largest_difference") <= tolerance)
