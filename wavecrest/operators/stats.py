"""One-way analysis of variance and post-hoc tests over (sample_id, label, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.functions.distributions import f_sf, t_sf2
from wavecrest.functions.sql import tail, tukey_tail


def group_stats(features: DataFrame) -> DataFrame:
    """(feature, label, n, mean, std, ss): one shuffle of partial sums by feature and label."""
    return features.groupBy("feature", "label").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), (F.var_pop("value") * F.count("value")).alias("ss"))


def anova(groups: DataFrame, with_p: bool = True) -> DataFrame:
    """(feature, f, df_b, df_w, eta2[, p]) of group statistics; tests on few rows, one a feature."""
    total = groups.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("mean")).alias("sx"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sm"))
    ssb = F.col("sm") - F.col("sx") * F.col("sx") / F.col("n")
    df_b, df_w = F.col("k") - 1, F.col("n") - F.col("k")
    out = total.select("feature", ((ssb / df_b) / (F.col("ssw") / df_w)).alias("f"), df_b.alias("df_b"), df_w.alias("df_w"), (F.col("ssw") / df_w).alias("msw"))
    eta = F.col("f") * F.col("df_b") / (F.col("f") * F.col("df_b") + F.col("df_w"))
    out = out.withColumn("eta2", eta)
    return out.withColumn("p", tail(f_sf)("f", F.col("df_b").cast("double"), F.col("df_w").cast("double"))) if with_p else out


def select_features(tested: DataFrame, k: int | None = None, alpha: float = 0.05) -> DataFrame:
    """The k features of largest F in order of name, or those with p < alpha in falling order of F."""
    if k is not None:
        return tested.orderBy(F.desc("f"), "feature").limit(k).orderBy("feature")
    return tested.where(F.col("p") < alpha).orderBy(F.desc("f"), "feature")


def _pairs(groups: DataFrame) -> DataFrame:
    a = groups.select("feature", F.col("label").alias("g1"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("ss").alias("s1"))
    b = groups.select("feature", F.col("label").alias("g2"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("ss").alias("s2"))
    return a.join(b, "feature").where("g1 < g2")


def bonferroni(groups: DataFrame, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """(feature, g1, g2, diff, t, df[, p, significant]): pooled t-tests, diff is g1 less g2."""
    df = F.col("n1") + F.col("n2") - 2
    pooled = (F.col("s1") + F.col("s2")) / df
    out = _pairs(groups).select("feature", "g1", "g2", (F.col("m1") - F.col("m2")).alias("diff"), ((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), df.alias("df"))
    if not with_p:
        return out
    tests = groups.groupBy("feature").agg((F.count("*") * (F.count("*") - 1) / 2).alias("tests"))
    out = out.withColumn("p", tail(t_sf2)("t", F.col("df").cast("double"))).join(tests, "feature")
    return out.withColumn("significant", F.col("p") < alpha / F.col("tests")).drop("tests")


def tukey(groups: DataFrame, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """(feature, g1, g2, diff, q[, p, significant]): Tukey-Kramer, diff is g2 less g1."""
    tested = anova(groups, with_p=False).select("feature", "msw", "df_w", (F.col("df_b") + 1).alias("k"))
    out = _pairs(groups).join(tested, "feature")
    q = F.abs(F.col("m1") - F.col("m2")) / F.sqrt(F.col("msw") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = out.select("feature", "g1", "g2", (F.col("m2") - F.col("m1")).alias("diff"), q.alias("q"), "k", "df_w")
    if with_p:
        out = out.withColumn("p", tail(tukey_tail)("q", F.col("k").cast("double"), F.col("df_w").cast("double"))).withColumn("significant", F.col("p") < alpha)
    return out.drop("k", "df_w")


def statistical_analysis(features: DataFrame, k: int | None = None, alpha: float = 0.05, method: str = "tukey") -> dict[str, DataFrame]:
    groups = group_stats(features)
    tested = anova(groups)
    chosen = select_features(tested, k, alpha)
    held = groups.join(chosen.select("feature"), "feature", "left_semi")
    return {"groups": groups, "anova": tested, "selected": chosen, "pairwise": tukey(held, alpha) if method == "tukey" else bonferroni(held, alpha)}
