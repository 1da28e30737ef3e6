"""Whole analyses as named tables; ``save`` writes them."""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.operators import channels as C
from wavecrest.operators import connectivity, learn, spectrum, stats, trp, windows
from wavecrest.operators.quarantine import status, told
from wavecrest.operators.ranges import numbered
from wavecrest.sources import recordings as R
from wavecrest.storage import stored


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recordings, failures) of a folder or file by its kind (JSON and MAT, or NPY); a file that can't be read is a failure."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"mat": [R.mat_files], "npy": [R.npy_files], "json": [R.json_files]}.get(kind, [R.json_files, R.mat_files])
    outcomes = [reader(spark, path) for reader in readers]
    return functools.reduce(DataFrame.unionByName, [x.good for x in outcomes]), functools.reduce(DataFrame.unionByName, [x.failed for x in outcomes])


def load(spark: SparkSession, path: str, convert: bool = True, channels: DataFrame | None = None) -> DataFrame:
    """The recordings that ``read`` gives, with 64 channels if they have 63 and ``convert``, and channel names."""
    return named(spark, read(spark, path)[0], convert, channels)


def named(spark: SparkSession, recordings: DataFrame, convert: bool = True, channels: DataFrame | None = None) -> DataFrame:
    if convert:
        recordings = C.interpolate_cz(recordings)
    return R.with_channels(recordings, channels if channels is not None else R.montage(spark, R.CHANNELS_64 if convert else None))


def unusable(recordings: DataFrame, stage: str = "spectra") -> DataFrame:
    """(subject, task, stage, error) of recordings with a null or empty channel; no signal is moved for it."""
    error = F.when(F.col("signal").isNull(), F.concat(F.lit("channel "), "ch_idx", F.lit(" has no signal"))).when(F.size("signal") == 0, F.concat(F.lit("channel "), "ch_idx", F.lit(" has no samples")))
    bad = recordings.select(F.col("subject").cast("string").alias("subject"), F.col("task").cast("string").alias("task"), "ch_idx", error.alias("e")).where("e is not null")
    return bad.groupBy("subject", "task").agg(F.min_by("e", "ch_idx").alias("error")).select("subject", "task", F.lit(stage).alias("stage"), "error")


def analyze(recordings: DataFrame, sfreq: float, nperseg: int = 1024, noverlap: int | None = None, window: str = "hann", alpha: tuple[float, float] = (8.0, 13.0), faa_db: bool = False, trp_mode: str = "logratio", trp_baseline: str | None = "1_rest", failures: DataFrame | None = None) -> dict[str, DataFrame]:
    """psd, metrics, faa and trp of recordings (subject, task, ch_idx, channel, signal), and status: ok and error of each recording.

    ``failures`` are those of reading. A null or empty channel has null measures, and its recording isn't ok; the others are as they would be without it.
    """
    psd = spectrum.spectra(recordings, sfreq, nperseg, noverlap, window)
    powers = spectrum.band_powers(psd)
    bad = unusable(recordings)
    tables = {"psd": psd, "metrics": spectrum.metrics(psd, alpha), "faa": spectrum.asymmetry(psd, lo=alpha[0], hi=alpha[1], db=faa_db), "trp": trp.task_related_power(powers, trp_mode, trp_baseline)}
    return tables | {"status": status(recordings, bad if failures is None else bad.unionByName(failures))}


def plot_table(values: DataFrame, channels: DataFrame, mode: str = "logratio", form: str = "auto", layout: str = "collapsed", merges: list[str] = (), only_merged: bool = False, exclude: list[str] = (), file_mode: str = "ratio", keys: tuple[str, str] | None = None) -> DataFrame:
    """Mean and standard error by condition with the order and label of each point of a line plot.

    ``mode`` is the axis's and ``file_mode`` the values'; ``keys`` are the bands to show, all if not given.
    """
    means = trp.region_means(values.where(F.col("band").isin(*keys)) if keys else values, channels)
    if merges:
        tasks = [r[0] for r in means.select("task").distinct().orderBy("task").collect()]
        means = trp.merge_conditions(means, trp.parse_merges(list(merges), tasks), not only_merged)
    means = trp.exclude_conditions(means, list(exclude))
    means = trp.collapse(means) if layout == "collapsed" else means
    table = trp.mean_sem(means, trp.auto_transform(file_mode, mode) if form == "auto" else form)
    regions = F.array(*[F.lit(r) for r in ("frontal", "central", "temporal", "parietal", "occipital")])
    place = F.array_position(regions, F.col("region"))
    if layout == "collapsed":
        return table.withColumns({"x": place, "x_label": F.col("region")})
    return table.withColumns({"x": place + F.when(F.col("hemisphere") == "RH", 5).otherwise(0), "x_label": F.concat_ws("-", "hemisphere", "region")})


def connectivity_analysis(recordings: DataFrame, sfreq: float = 500.0, freq_range: tuple[float, float] = (8.0, 13.0), least: float = 0.2, classes: dict[str, str] | None = None, measure: str = "wpli", bins: int | None = None, detrend: bool = False, intermediates: bool = False, failures: DataFrame | None = None) -> dict[str, DataFrame]:
    """edges, graph measures, features (with the class of each task), their long form, class counts, and status: ok and error of each recording.

    ``measure`` is ``wpli`` (phase lag in ``freq_range``, each channel less its line if ``detrend``), ``mi`` (mutual information over ``bins`` bins), ``coh`` or ``plv`` (multitaper spectra). Edges and failures are one pass over the
    recordings, stored once for all that is made of them. ``intermediates`` adds the band-passed analytic signals; ``failures`` are those of reading.
    """
    if measure == "wpli":
        found = connectivity.phase_lags(recordings, sfreq, *freq_range, detrend)
    elif measure == "mi":
        found = connectivity.informations(recordings, bins)
    else:
        found = connectivity.spectral_measures(recordings, sfreq, *freq_range, methods=(measure,))
    found = found._replace(both=stored(found.both.withColumnRenamed(measure, "w"), "edges"))
    bad = found.failed if failures is None else found.failed.unionByName(failures)
    edges = found.good.where("i < j")
    features = connectivity.graph_features(edges, least).withColumns({"label": learn.task_class(F.col("task"), classes), "sample_id": F.concat_ws("/", "subject", "task")}).where("label is not null")
    n = F.size("features") / 2
    name = F.when(F.col("k") < n, F.concat(F.lit("betweenness_"), F.col("k"))).otherwise(F.concat(F.lit("strength_"), (F.col("k") - n).cast("int")))
    long = features.select("sample_id", "label", "features", F.posexplode("features").alias("k", "value")).select("sample_id", "label", name.alias("feature"), "value")
    out = {"edges": edges, "matrix": connectivity.matrices(edges), "graphs": connectivity.graph_summary(edges, least), "top": connectivity.top_nodes(connectivity.strength(edges), "strength"), "features": features, "long": long, "classes": features.groupBy("label").count(), "status": status(recordings, bad)}
    return out | ({"analytic": connectivity.analytic_signals(recordings.where(F.size("signal") > 0), sfreq, *freq_range)} if intermediates else {})


def train_classifiers(features: DataFrame, seed: int = 42, cv_folds: int = 5) -> dict[str, DataFrame]:
    """Confusion, report, accuracy (held out, train and cross-validated over the rows not held out) of each classifier, and failures (stage, error) if there are any.

    A classifier that fails, as with one class or too few rows, has a row in ``failures`` and no tables; the others go on. The rows, split and scaled, and
    each classifier's predictions are stored once. Rows without features or with a number that is null are left out and told of.
    """
    spark = features.sparkSession
    chosen = features.select("sample_id", "label", "features")
    fit = F.col("label").isNotNull() & F.coalesce(F.size("features") > 0, F.lit(False)) & F.coalesce(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    scaled = stored(learn.standardise(learn.split(chosen.where(fit), seed=seed)), "scaled")
    out, failed = {}, [("rows", f"{n} rows without a label or with a null feature") for n in [chosen.where(~fit).count()] if n]
    for model in ("knn", "mlp", "svm"):
        try:
            said = stored(learn.predict(scaled, model, seed), f"{model}-predictions")
            train = stored(learn.predict(scaled.where(~F.col("test")), model, seed, of_train=True), f"{model}-train")
            scores = stored(learn.cross_validate(scaled.where(~F.col("test")).drop("test"), model, cv_folds, seed), f"{model}-folds")
        except Exception as e:  # noqa: BLE001 - told in the failures
            failed.append((model, told(e)[:2000]))
            continue
        out |= {f"{model}_confusion": learn.confusion(said), f"{model}_report": learn.report(said), f"{model}_folds": scores}
        train_accuracy = learn.summary(train).select(F.col("accuracy").alias("train_accuracy"))
        out[f"{model}_summary"] = learn.summary(said).crossJoin(train_accuracy).crossJoin(learn.cross_summary(scores))  # one row each
    return out | ({"failures": spark.createDataFrame(failed, "stage string, error string")} if failed else {})


def dynamic_windows(recordings: DataFrame | None, labels: DataFrame, sfreq: float, mode: str = "run", nperseg: int = 1024, least_window_sec: float = 1.0, half: int = 3, least_state_ms: float = 80.0, line: str | None = "B", group_sec: float = 5.0, macro: tuple[int, int] = (1, 1), n_clusters: int = 4, least_subtask_sec: float = 10.0, noverlap: int | None = None, window: str = "hann", alpha: tuple[float, float] = (8.0, 13.0), faa_db: bool = False) -> dict[str, DataFrame]:
    """windows, those skipped and why, and, with ``recordings``, psd, metrics and faa of each used window.

    Labels and recordings count as far as both go, by subject, and by task where labels have one.
    """
    by = ["subject", "task"] if "task" in labels.columns else ["subject"]
    labels = labels.withColumns({c: F.col(c).cast("string") for c in by})
    if recordings is not None:
        recordings = recordings.withColumns({c: F.col(c).cast("string") for c in ("subject", "task")})
        both = recordings.groupBy(*by).agg(F.min(F.coalesce(F.size("signal"), F.lit(0))).alias("_n"))
        labels = labels.join(both, by).where(F.col("t") < F.col("_n")).drop("_n")
    if mode == "run":
        found = windows.run_windows(labels, sfreq, half, least_state_ms, least_window_sec)
    else:
        parts = windows.segment(labels, sfreq, group_sec, windows.PRESETS.get(line or "", macro), n_clusters, least_subtask_sec, half, least_state_ms)
        cut = parts.withColumns({"start_sample": F.bround(F.col("start_sec") * sfreq).cast("long"), "end_sample": F.bround(F.col("end_sec") * sfreq).cast("long")})
        ends = labels.groupBy(*by).agg((F.max("t") + 1).alias("n_times"))
        found = windows.timed(windows.clip_windows(cut.join(ends, by), F.col("n_times"), round(least_window_sec * sfreq)), sfreq).drop("n_times")
    order = ["start_sample", "end_sample"]
    found = numbered(found, by, F.col("start_sample"), order, "index")
    used = numbered(found.where("reason is null"), by, F.col("start_sample"), order, "window_index").drop("index", "reason")
    out = {"windows": used, "skipped": found.where("reason is not null").select(*by, "index", "start_sample", "end_sample", "n_samples", "reason")}
    if recordings is None:
        return out
    psd = spectrum.spectra(windows.window_signals(recordings, used.select(*by, "window_index", "start_sample", "end_sample")), sfreq, nperseg, noverlap, window)
    return out | {"psd": psd, "metrics": spectrum.metrics(psd, alpha), "faa": spectrum.asymmetry(psd, lo=alpha[0], hi=alpha[1], db=faa_db, by=("subject", "task", "window_index"))}


def one_recording(recordings: DataFrame, task: str | None = None) -> DataFrame:
    """A task, the first in order if not named, of the first subject in order."""
    subject = recordings.agg(F.min("subject")).first()[0]
    own = recordings.where(F.col("subject") == subject)
    tasks = sorted(r[0] for r in own.select("task").distinct().collect())
    if task is not None and task not in tasks:
        raise ValueError(f"no task {task!r}; there are {tasks}")
    return own.where(F.col("task") == (task or tasks[0]))


def task_json(recordings: DataFrame) -> DataFrame:
    """(subject, value): each subject's recordings as the JSON text that ``read_task_json`` reads; NaN is null."""
    rows = F.sort_array(F.collect_list(F.struct("ch_idx", F.transform("signal", lambda x: F.nanvl(x, F.lit(None).cast("double"))).alias("x"))))
    tasks = recordings.groupBy("subject", "task").agg(rows.alias("r")).select("subject", "task", F.col("r.x").alias("x"))
    return tasks.groupBy("subject").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "x"))))).alias("value"))


def convert_to_json(spark: SparkSession, path: str, out: str, convert: bool = True) -> None:
    """Writes MAT (or other) recordings as task JSON, a folder ``subject=...`` for each subject."""
    task_json(load(spark, path, convert).drop("channel")).write.mode("overwrite").partitionBy("subject").text(out)


def save(tables: Mapping[str, DataFrame], out: str, form: str = "parquet", /, **params) -> None:
    """Writes each table as Parquet or lines of JSON, and the parameters as one line of JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(params, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
