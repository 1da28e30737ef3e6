"""Command line: ``python -m wavecrest.cli VERB ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from wavecrest.operators import stats, trp, windows
from wavecrest.plans import pipelines
from wavecrest.session import build_session
from wavecrest.sources import recordings as R
from wavecrest.storage import stored


def _pair(text: str) -> tuple[float, float]:
    lo, hi = (float(x) for x in text.split(","))
    return lo, hi


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wavecrest")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, **options) -> None:
        v = verbs.add_parser(name)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is False:
                v.add_argument(flag, action="store_true")
            elif default == []:
                v.add_argument(flag, action="append", default=[])
            elif isinstance(default, type):
                v.add_argument(flag, type=default, required=True)
            else:
                v.add_argument(flag, type=type(default) if default is not None else str, default=default)

    smoothing = {"smooth_window_w": 3, "min_state_duration_ms": 80.0, "n_microstates": 4, "ms_n_runs": 25, "labels_npy": None, "eeg_npy": None}
    parts = {"group_sec": 5.0, "macro_window_size": 0, "macro_window_stride": 0, "n_clusters": 4, "min_subtask_sec": 10.0}
    spectra = {"nperseg": 1024, "noverlap": 0, "window": "hann", "alpha": "8,13", "faa_db": False, "channels_file": None, "n_channels": 0}
    verb("analyze", input=str, sfreq=float, out_dir=str, trp_baseline="1_rest", trp_mode="logratio", form="parquet", **spectra)
    verb("plot-trp", out_dir=str, summary=[], summary_dir=None, summary_glob="trp_1_rest.json", montage=None, layout="collapsed", mode="logratio", transform="auto", exclude_midline=False, lower_key=None, upper_key=None, merge=[], only_merged=False, exclude_condition=[])
    verb("design-creativity", input=str, out_dir=str, sfreq=500.0, freq_range="8,13", threshold=0.2, measure="wpli", detrend=False, save_intermediates=False, channels_file=None, n_channels=0, no_classification=False)
    verb("statistical-analysis", results_dir=str, out_dir=None, alpha=0.05, pairwise="tukey")
    verb("segment-protocol", sfreq=float, out_dir=str, line="none", lambda_reg=0.25, **smoothing, **parts)
    verb("dynamic-window", mode=str, sfreq=float, out_dir=str, line="B", min_window_sec=1.0, input=None, task=None, ms_n_std=3.0, ms_distance=10, ms_all_samples=False, save_psd=False, **smoothing, **parts, **spectra)
    verb("convert-json", input=str, out_dir=str, n_channels=0)
    return top


def _channels(spark, path: str | None):
    return R.read_channels(spark, path) if path else None


def _plot_trp(spark, a: argparse.Namespace) -> dict:
    montage = R.read_locs(spark, a.montage) if a.montage else R.montage(spark, R.CHANNELS_64)
    values = R.placed(R.read_trp_summaries(spark, a.summary_dir, a.summary_glob, a.summary), montage).withColumnRenamed("value", "trp")
    file_mode = values.agg(F.min_by("mode", "file")).first()[0] or "ratio"  # the first file's
    bands = sorted(r[0] for r in values.select("band").distinct().collect())
    keys = trp.band_keys(bands, a.lower_key, a.upper_key)
    return {"plot": pipelines.plot_table(values, montage, a.mode or file_mode, a.transform, a.layout, a.merge, a.only_merged, a.exclude_condition, file_mode, keys)}


def _dynamic(spark, a: argparse.Namespace) -> dict:
    eeg = None
    if a.eeg_npy:
        eeg = R.with_channels(R.read_npy(spark, a.eeg_npy), _channels(spark, getattr(a, "channels_file", None)) or R.montage(spark))
    elif getattr(a, "input", None):
        eeg = pipelines.one_recording(pipelines.load(spark, a.input, a.n_channels == 64, _channels(spark, a.channels_file)), a.task)
    if eeg is not None:
        eeg = eeg.withColumn("subject", F.lit("eeg"))
    tables = {}
    if a.labels_npy:
        found = R.npy_labels(spark, a.labels_npy).select(F.lit("eeg").alias("subject"), "t", "label")
    elif eeg is not None:
        more = {} if a.verb == "segment-protocol" else {"peaks_only": not a.ms_all_samples, "n_std": a.ms_n_std, "distance": a.ms_distance}
        fitted = windows.labels_fitted(eeg, a.n_microstates, a.ms_n_runs, **more)
        fitted = fitted._replace(both=stored(fitted.both, "labels"))
        found, tables = fitted.good, {"computed_labels": fitted.good, "failures": fitted.failed}
    else:
        raise SystemExit("give labels or a recording to fit them to")
    size = a.macro_window_size or windows.PRESETS.get(a.line, (1, 1))[0]
    macro = (size, a.macro_window_stride or (size if a.macro_window_size else windows.PRESETS.get(a.line, (1, 1))[1]))
    if a.verb == "segment-protocol":
        return tables | {"segments": windows.segment(found, a.sfreq, a.group_sec, macro, a.n_clusters, a.min_subtask_sec, a.smooth_window_w, a.min_state_duration_ms)}
    line = a.line if not (a.macro_window_size or a.macro_window_stride) else None
    got = pipelines.dynamic_windows(eeg, found, a.sfreq, a.mode, a.nperseg, a.min_window_sec, a.smooth_window_w, a.min_state_duration_ms, line, a.group_sec, macro, a.n_clusters, a.min_subtask_sec, a.noverlap or None, a.window, _pair(a.alpha), a.faa_db)
    return tables | {k: v for k, v in got.items() if k != "psd" or a.save_psd}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    form, out = "parquet", a.out_dir
    if a.verb == "convert-json":
        return pipelines.convert_to_json(spark, a.input, a.out_dir, a.n_channels in (0, 64))
    if a.verb == "analyze":
        form = a.form
        found, failed = pipelines.read(spark, a.input)
        found = pipelines.named(spark, found, a.n_channels in (0, 64), _channels(spark, a.channels_file))
        tables = pipelines.analyze(found, a.sfreq, a.nperseg, a.noverlap or None, a.window, _pair(a.alpha), a.faa_db, a.trp_mode, a.trp_baseline, failed)
    elif a.verb == "plot-trp":
        tables = _plot_trp(spark, a)
    elif a.verb == "design-creativity":
        found, failed = pipelines.read(spark, a.input)
        found = pipelines.named(spark, found, a.n_channels in (0, 64), _channels(spark, a.channels_file))
        tables = pipelines.connectivity_analysis(found, a.sfreq, _pair(a.freq_range), a.threshold, measure=a.measure, detrend=a.detrend, intermediates=a.save_intermediates, failures=failed)
    elif a.verb == "statistical-analysis":
        tables, out = stats.statistical_analysis(spark.read.parquet(f"{a.results_dir}/long"), None, a.alpha, a.pairwise), f"{a.out_dir or a.results_dir}/statistics"
    else:
        tables = _dynamic(spark, a)
    pipelines.save(tables, out, form, **vars(a))
    if a.verb == "design-creativity" and not a.no_classification:
        tables = pipelines.train_classifiers(spark.read.parquet(f"{a.out_dir}/features"))
        for stage, error in tables["failures"].collect() if "failures" in tables else ():  # one a classifier at most
            print(f"warning: {stage}: {error.splitlines()[0]}", file=sys.stderr)
        pipelines.save(tables, f"{a.out_dir}/classification", **vars(a))


if __name__ == "__main__":
    main()
