"""Queries over the test tables and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import spectral as S
from wavecrest.operators import channels, connectivity, learn, spectrum, stats, trp, windows
from wavecrest.sources.recordings import montage, samples
from wavecrest.sources.views import embedding_signals, event_labels, event_samples, table
from wavecrest.storage import stored

SFREQ, NPERSEG = 64.0, 32
KEYS = ["subject", "task", "ch_idx"]


def _r(x, digits: int = 9):
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def _psd(spark: SparkSession, sf: str) -> DataFrame:
    return spectrum.spectra(embedding_signals(spark, sf), SFREQ, NPERSEG)


def montage_regions(spark, sf):
    n = embedding_signals(spark, sf).groupBy("ch_idx", "channel").agg(F.count("*").alias("n_signals"))
    return n.select("ch_idx", "channel", channels.hemisphere(F.col("channel")).alias("hemisphere"), channels.region(F.col("channel")).alias("region"), "n_signals")


def cz_interpolate(spark, sf):
    return samples(channels.interpolate_cz(embedding_signals(spark, sf))).select("subject", "task", "ch_idx", F.col("t").cast("long").alias("t"), _r(F.col("x")).alias("x"))


def cz_verify(spark, sf):
    before = embedding_signals(spark, sf)
    return channels.verify_cz(before, channels.interpolate_cz(before)).select("subject", "task", "block", "ok")


def welch_psd(spark, sf):
    bins = _psd(spark, sf).select(*KEYS, F.posexplode(F.arrays_zip("freq", "p")).alias("bin", "x"))
    return bins.select(*KEYS, "bin", F.col("x.freq").alias("f"), _r(F.col("x.p"), 12).alias("p"))


def band_power_abs(spark, sf):
    return spectrum.band_powers(_psd(spark, sf)).select(*KEYS, "band", _r(F.col("power"), 12).alias("power"))


def band_power_rel(spark, sf):
    return spectrum.band_powers(_psd(spark, sf), relative=True).select(*KEYS, "band", _r(F.col("power")).alias("power"))


def spectral_entropy(spark, sf):
    return _psd(spark, sf).select(*KEYS, _r(S.spectral_entropy(F.col("freq"), F.col("p"))).alias("entropy"))


def spectral_moments(spark, sf):
    m = _psd(spark, sf).select(*KEYS, S.spectral_moments(F.col("freq"), F.col("p")).alias("m"))
    return m.select(*KEYS, *[_r(F.col(f"m.{c}"), 6).alias(c) for c in ("centroid", "variance", "skewness", "kurtosis")])


def spectral_edge_95(spark, sf):
    return _psd(spark, sf).select(*KEYS, S.spectral_edge(F.col("freq"), F.col("p"), 0.95).alias("sef95"))


def median_frequency(spark, sf):
    return _psd(spark, sf).select(*KEYS, S.spectral_edge(F.col("freq"), F.col("p"), 0.5).alias("f50"))


def peak_alpha(spark, sf):
    return _psd(spark, sf).select(*KEYS, S.peak_frequency(F.col("freq"), F.col("p")).alias("iaf"))


def peak_smoothed(spark, sf):
    return _psd(spark, sf).select(*KEYS, S.individual_alpha(F.col("freq"), F.col("p"), 1.0, 45.0).alias("peak"))


def alpha_asymmetry(spark, sf):
    return spectrum.asymmetry(_psd(spark, sf)).select("subject", "task", _r(F.col("faa")).alias("faa"))


def _trp(spark, sf, mode="logratio", baseline="1_rest"):
    return trp.task_related_power(spectrum.band_powers(_psd(spark, sf)), mode, baseline)


def _trp_query(mode: str, baseline: str | None = "1_rest"):
    return lambda spark, sf: _trp(spark, sf, mode, baseline).select("subject", "task", "band", "ch_idx", _r(F.col("trp"), 6).alias("trp"))


def _regions(spark, sf):
    return trp.region_means(_trp(spark, sf), montage(spark))


def trp_region_mean_sem(spark, sf):
    return trp.mean_sem(_regions(spark, sf)).select("task", "band", "hemisphere", "region", _r(F.col("mean"), 6).alias("mean"), _r(F.col("sem"), 6).alias("sem"), "n")


def trp_collapsed_merged(spark, sf):
    merged = trp.merge_conditions(_regions(spark, sf), trp.parse_merges(["ideas=*idea*"], ["1_idea generation", "1_rest"]), keep_others=True)
    kept = trp.exclude_conditions(merged, ["*rest*"])
    return trp.mean_sem(trp.collapse(kept)).select("task", "band", "region", _r(F.col("mean"), 6).alias("mean"), _r(F.col("sem"), 6).alias("sem"), "n")


def _event_recordings(spark, sf, whole: bool = False):
    """Recordings of buckets of users, in three tasks, or in one if ``whole``."""
    x = event_samples(spark, sf)
    numbers = x.select("ch").distinct().agg(F.array_sort(F.collect_list("ch")).alias("_chs"))  # a handful of event types
    rows = x.join(F.broadcast(numbers), F.lit(True)).withColumn("ch_idx", (F.array_position("_chs", F.col("ch")) - 1).cast("int"))
    t, task = (F.col("h"), F.lit("all")) if whole else (F.col("t"), F.col("task"))
    grouped = rows.groupBy("subject", task.alias("task"), "ch_idx").agg(F.array_sort(F.collect_list(F.struct(t.alias("t"), "x"))).alias("s"))
    return grouped.select("subject", "task", "ch_idx", F.col("s.x").alias("signal"))


def _task():
    """A recording's name."""
    return F.concat_ws(":", "subject", "task").alias("task")


def _edges(spark, sf):
    return connectivity.phase_lag_edges(_event_recordings(spark, sf), 100.0, None)


def wpli_edges(spark, sf):
    return _edges(spark, sf).select(_task(), "i", "j", _r(F.col("w")).alias("w"))


def wpli_edges_bandpass(spark, sf):
    return connectivity.phase_lag_edges(_event_recordings(spark, sf), 100.0, 8.0, 13.0).select(_task(), "i", "j", _r(F.col("w")).alias("w"))


def mutual_information(spark, sf):
    return connectivity.mutual_information(_event_recordings(spark, sf)).select(_task(), "i", "j", _r(F.col("w"), 6).alias("mi"))


def mi_graph_features(spark, sf):
    edges = connectivity.mutual_information_edges(_event_recordings(spark, sf))
    return connectivity.graph_features(edges, 0.7).select(_task(), F.transform("features", lambda x: F.round(x, 6) + 0.0).alias("features"))


def spectral_connectivity(spark, sf):
    got = connectivity.spectral_connectivity(_event_recordings(spark, sf, whole=True), 100.0, 8.0, 13.0, diagonal=True)
    return got.select("subject", "i", "j", *[_r(F.col(c), 6).alias(c) for c in ("wpli", "coh", "plv")])


def node_strength(spark, sf):
    return connectivity.strength(_edges(spark, sf)).select(_task(), "node", _r(F.col("strength"), 6).alias("strength"))


def threshold_edges(spark, sf):
    return connectivity.threshold(_edges(spark, sf), 0.05).select(_task(), "i", "j", _r(F.col("w"), 6).alias("w"))


def node_betweenness(spark, sf):
    return connectivity.betweenness(connectivity.threshold(_edges(spark, sf), 0.05)).select(_task(), "node", _r(F.col("betweenness"), 6).alias("betweenness"))


def graph_features(spark, sf):
    return connectivity.graph_features(_edges(spark, sf), 0.05).select(_task(), F.transform("features", lambda x: F.round(x, 6) + 0.0).alias("features"))


def graph_summary(spark, sf):
    return connectivity.graph_summary(_edges(spark, sf), 0.05).select(_task(), "n_edges", _r(F.col("density")).alias("density"), "connected")


def top_strength(spark, sf):
    return connectivity.top_nodes(connectivity.strength(_edges(spark, sf)), "strength", 2).select(_task(), "node", _r(F.col("strength"), 6).alias("strength"), "rank")


def connectivity_matrix(spark, sf):
    return connectivity.matrices(_edges(spark, sf)).select(_task(), "nodes", F.transform("matrix", lambda x: F.transform(x, lambda y: F.round(y, 6) + 0.0)).alias("matrix"))


def label_runs(spark, sf):
    return windows.label_runs(event_labels(spark, sf)).select("subject", "label", "start_sample", "end_sample")


def label_smooth(spark, sf):
    return windows.smooth_labels(event_labels(spark, sf), 2).select("subject", "t", "label")


def run_windows(spark, sf):
    return windows.run_windows(event_labels(spark, sf), 1.0, 2, 2000.0, 2.0)


def fine_groups(spark, sf):
    return windows.fine_groups(event_labels(spark, sf), 5, 2).select("subject", "grp", "n", _r(F.col("hardness"), 6).alias("hardness"))


def macro_windows(spark, sf):
    return windows.macro_windows(windows.fine_groups(event_labels(spark, sf), 5, 2), 3, 2).select("subject", "macro", "first_group", _r(F.col("hardness"), 6).alias("hardness"))


def segmentation(spark, sf):
    return windows.segment(event_labels(spark, sf), 1.0, 5.0, (1, 1), 3, 10.0, 2, 2000.0)


def window_metrics(spark, sf):
    recordings = _event_recordings(spark, sf, whole=True)
    first = (F.col("subject") * 6).cast("int")
    cuts = recordings.select("subject").distinct().select("subject", F.explode(F.sequence(first, first + 5)).alias("window_index"))
    cuts = cuts.withColumns({"start_sample": F.col("window_index") % 6 * 120, "end_sample": F.col("window_index") % 6 * 120 + 120})
    psd = spectrum.spectra(windows.window_signals(recordings, cuts, 200), 100.0, 64)
    return psd.select("window_index", "ch_idx", _r(S.spectral_entropy(F.col("freq"), F.col("p")), 6).alias("entropy"), S.spectral_edge(F.col("freq"), F.col("p"), 0.95).alias("sef95"))


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _features(spark, sf):
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _MEASURES])
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), F.explode(each).alias("x")).select("label", "x.feature", "x.value")


def _groups(spark, sf):
    return stats.group_stats(_features(spark, sf))


def anova_groups(spark, sf):
    return _groups(spark, sf).select("feature", "label", "n", _r(F.col("mean"), 6).alias("mean"), _r(F.col("std"), 6).alias("std"))


def anova_f(spark, sf):
    return stats.anova(_groups(spark, sf), with_p=False).select("feature", _r(F.col("f"), 6).alias("f"), "df_b", "df_w", _r(F.col("eta2")).alias("eta2"))


def anova_p(spark, sf):
    return stats.anova(_groups(spark, sf)).select("feature", _r(F.col("p"), 6).alias("p"))


def select_features(spark, sf):
    return stats.select_features(stats.anova(_groups(spark, sf), with_p=False), 2).select("feature", _r(F.col("f"), 6).alias("f"))


def bonferroni_t(spark, sf):
    return stats.bonferroni(_groups(spark, sf), with_p=False).select("feature", "g1", "g2", _r(F.col("diff"), 6).alias("diff"), _r(F.col("t"), 6).alias("t"), "df")


def tukey_q(spark, sf):
    return stats.tukey(_groups(spark, sf), with_p=False).select("feature", "g1", "g2", _r(F.col("diff"), 6).alias("diff"), _r(F.col("q"), 6).alias("q"))


def tukey_p(spark, sf):
    return stats.tukey(_groups(spark, sf)).select("feature", "g1", "g2", _r(F.col("p"), 4).alias("p"), "significant")


def _samples(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    return learn.split(rows)


def stratified_split(spark, sf):
    return _samples(spark, sf).select("sample_id", "label", "test")


def stratified_folds(spark, sf):
    return learn.folds(_samples(spark, sf).where(~F.col("test"))).select("sample_id", "label", "fold")


def standardise(spark, sf):
    return learn.standardise(_samples(spark, sf)).select("sample_id", F.posexplode("features").alias("k", "v")).select("sample_id", "k", _r(F.col("v"), 6).alias("v"))


def _knn(spark, sf):
    scaled = stored(learn.standardise(_samples(spark, sf)), "scaled")
    test = scaled.where("test")
    return learn.nearest(scaled.where(~F.col("test")), test, 5).join(test.select("sample_id", "label"), "sample_id")


def knn_predict(spark, sf):
    return _knn(spark, sf).select("sample_id", "label", "predicted")


def knn_confusion(spark, sf):
    return learn.confusion(_knn(spark, sf))


def knn_summary(spark, sf):
    return learn.summary(_knn(spark, sf)).select(_r(F.col("accuracy")).alias("accuracy"), "n")


def knn_folds(spark, sf):
    scaled = learn.standardise(_samples(spark, sf)).where(~F.col("test")).drop("test")
    return learn.cross_validate(scaled, "knn").select("fold", _r(F.col("accuracy")).alias("accuracy"), "n")


def knn_report(spark, sf):
    return learn.report(_knn(spark, sf)).select("label", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def mlp_report(spark, sf):
    return learn.report(learn.classify(learn.standardise(_samples(spark, sf)), "mlp"))


def svm_report(spark, sf):
    return learn.report(learn.classify(learn.standardise(_samples(spark, sf)), "svm"))


def task_classes(spark, sf):
    return embedding_signals(spark, sf).select("subject", "task").distinct().select("subject", "task", learn.task_class(F.col("task")).alias("label"))


def nonfinite_to_null(spark, sf):
    x = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 3 == 1, float("inf")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", S.finite(x).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        montage_regions, cz_interpolate, cz_verify, welch_psd, band_power_abs, band_power_rel, spectral_entropy, spectral_moments, spectral_edge_95, median_frequency, peak_alpha, peak_smoothed,
        alpha_asymmetry, trp_region_mean_sem, trp_collapsed_merged, wpli_edges, wpli_edges_bandpass, mutual_information, mi_graph_features, spectral_connectivity, node_strength, threshold_edges,
        node_betweenness, graph_features, graph_summary, top_strength, connectivity_matrix, label_runs, label_smooth, run_windows, fine_groups, macro_windows, segmentation, window_metrics, anova_groups, anova_f, anova_p,
        select_features, bonferroni_t, tukey_q, tukey_p, stratified_split, stratified_folds, standardise, knn_predict, knn_confusion, knn_summary, knn_folds, knn_report, mlp_report, svm_report,
        task_classes, nonfinite_to_null,
    )
}
_MODES = {"trp_logratio": ("logratio", "1_rest"), "trp_ln": ("ln", "1_rest"), "trp_db": ("db", "1_rest"), "trp_ratio": ("ratio", "1_rest"), "trp_auto_baseline": ("logratio", None)}
QUERIES |= {name: _trp_query(*args) for name, args in _MODES.items()}
