"""Windows driven by labels: runs, smoothing, merging of short runs, segmentation, metrics of a window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.operators.quarantine import Outcome, guarded, signals
from wavecrest.operators.ranges import RANGE, before_ranges, match, numbered, with_margins

#: Size and stride in fine groups of the two presets.
PRESETS = {"A": (1, 1), "B": (5, 5)}


def _keys(labels: DataFrame) -> list[str]:
    """What names a sequence of labels: the subject, and the task where there is one."""
    return ["subject", "task"] if "task" in labels.columns else ["subject"]


def _pieces(labels: DataFrame, group: int | None = None, size: int = RANGE) -> DataFrame:
    """(keys, run, label, start, end, n) of the pieces of runs of equal labels that lie within one range of t, and, if given, within one group of ``group`` samples.

    Within a range a window finds where labels change. A range is summed up by its first and last label and its number of
    changes; from the summaries, one row a range, each range learns how many runs began before it and whether its first run goes on from
    the range before. A run has the same number in all its pieces.
    """
    by = _keys(labels)
    order = Window.partitionBy(*by, "_range").orderBy("t")
    marked = labels.select(*by, "t", "label", F.floor(F.col("t") / F.lit(size)).cast("long").alias("_range"))
    change = (F.row_number().over(order) > 1) & ~F.lag("label").over(order).eqNullSafe(F.col("label"))
    marked = marked.withColumn("_new", change.cast("int")).withColumn("_run", F.sum("_new").over(order))
    grp = [F.floor(F.col("t") / F.lit(group)).cast("long").alias("grp")] if group else []
    pieces = marked.groupBy(*by, "_range", "_run", *grp).agg(F.first("label").alias("label"), F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.count("*").alias("n"))
    heads = pieces.groupBy(*by, "_range").agg(F.max("_run").alias("_inner"), F.min_by(F.struct("label"), "start").alias("_first"), F.max_by(F.struct("label"), "start").alias("_last"))
    across = Window.partitionBy(*by).orderBy("_range")
    fresh = F.lag("_last").over(across).isNull() | ~F.lag("_last").over(across)["label"].eqNullSafe(F.col("_first.label"))
    heads = before_ranges(heads.withColumn("_fresh", fresh.cast("int")), by, {"_before": F.sum(F.col("_inner") + F.col("_fresh"))})
    found = match(pieces, heads.select(*by, "_range", "_fresh", "_before"), [*by, "_range"])
    return found.withColumn("run", F.col("_before") + F.col("_fresh") + F.col("_run")).drop("_range", "_run", "_fresh", "_before")


def label_runs(labels: DataFrame, size: int = RANGE) -> DataFrame:
    """(subject, run, label, start_sample, end_sample) of maximal runs of equal labels, ends excluded; a null is a label like others.

    ``labels`` is (subject, t, label), with task as a further key where it has one. Sequences are cut into ranges of ``size`` samples.
    """
    by = _keys(labels)
    runs = _pieces(labels, size=size).groupBy(*by, "run").agg(F.first("label").alias("label"), F.min("start").alias("start_sample"), F.max("end").alias("end_sample"))
    return runs.select(*by, "run", "label", "start_sample", "end_sample")


def smooth_labels(labels: DataFrame, half: int, size: int = RANGE) -> DataFrame:
    """The commonest label within ``half`` samples; the own label wins ties it is in, else the first by name.

    Samples near a range's end are read by its neighbour too, so frames lie within ranges.
    """
    by = _keys(labels)
    if half == 0:
        return labels.select(*by, "t", "label")
    near = F.collect_list("label").over(Window.partitionBy(*by, "_range").orderBy("t").rangeBetween(-half, half))
    held = with_margins(labels.select(*by, "t", "label"), F.col("t"), half, half, size).withColumn("_near", near).where("_inside")
    counts = F.transform(F.array_distinct("_near"), lambda x: F.struct((-F.size(F.filter("_near", lambda y: y == x))).alias("n"), (x != F.col("label")).cast("int").alias("other"), x.alias("label")))
    return held.select(*by, "t", F.array_min(counts)["label"].alias("label"))


def merge_runs(labels: list, sizes: list[int], least: int) -> tuple[list, list[int]]:
    """Runs shorter than ``least`` join the longer neighbour (the left of equal ones), left to right, until none is left.

    ``labels`` and ``sizes`` are runs in order; neighbours of one label count as one run. All runs before the one looked at are long enough, so what a
    short run can become is settled by its neighbours alone: it joins the run before, and the run after too if that has the same label, or the run after, which is looked
    at again. Each step takes a run away, so the work is in proportion to the runs.
    """
    done: list[list] = []
    ahead: list[list] = []  # in reverse order
    for x, n in zip(reversed(labels), reversed(sizes), strict=True):
        if ahead and ahead[-1][0] == x:
            ahead[-1][1] += n
        else:
            ahead.append([x, n])
    while ahead:
        run = ahead.pop()
        if done and done[-1][0] == run[0]:  # a run of the label before, grown from a short one
            done[-1][1] += run[1]
        elif run[1] >= least or not (done or ahead):
            done.append(run)
        elif done and (not ahead or done[-1][1] >= ahead[-1][1]):
            done[-1][1] += run[1]
        else:
            ahead[-1][1] += run[1]
    return [x for x, _ in done], [n for _, n in done]


def merge_short(labels: list, least: int) -> list:
    """``merge_runs`` of a label for each sample."""
    found, sizes = merge_runs(labels, [1] * len(labels), least)
    return [x for x, n in zip(found, sizes, strict=True) for _ in range(n)]


def merged_runs(runs: DataFrame, least: int) -> DataFrame:
    """``runs`` (label_runs) without those shorter than ``least`` samples; runs are taken to follow one another.

    Merging is sequential: a sequence's runs, not its samples, meet in one task.
    """
    by = _keys(runs)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        labels, sizes = merge_runs(pdf["label"].tolist(), (pdf["end_sample"] - pdf["start_sample"]).tolist(), least)
        ends = np.cumsum(sizes) + int(pdf["start_sample"].iloc[0])
        return pd.DataFrame({**dict(zip(by, key, strict=True)), "run": np.arange(1, len(labels) + 1), "label": labels, "start_sample": ends - sizes, "end_sample": ends})

    return runs.groupBy(*by).applyInPandas(run, runs.schema)


def regularised_runs(labels: DataFrame, half: int = 3, least_samples: int = 1) -> DataFrame:
    """Runs of smoothed labels, without short ones."""
    runs = label_runs(smooth_labels(labels, half))
    return runs if least_samples <= 1 else merged_runs(runs, least_samples)


def regularise(labels: DataFrame, half: int = 3, least_samples: int = 1) -> DataFrame:
    """Smoothed labels without short runs, one row a sample of the runs; samples between the first and the last are taken to be there."""
    by = _keys(labels)
    if least_samples <= 1:
        return smooth_labels(labels, half)
    runs = regularised_runs(labels, half, least_samples)
    return runs.select(*by, F.explode(F.sequence("start_sample", F.col("end_sample") - 1)).alias("t"), "label")


def clip_windows(windows: DataFrame, n_times, least_samples: int) -> DataFrame:
    """Windows cut to the recording; ``reason`` says why a window is too short to be used, else null.

    Both ends are held between 0 and ``n_times``, so a window outside the recording has no samples.
    """
    start, end = (F.greatest(F.lit(0), F.least(n_times, F.col(c))) for c in ("start_sample", "end_sample"))
    size = F.greatest(end - start, F.lit(0))
    return windows.withColumns({"start_sample": start, "end_sample": end, "n_samples": size, "reason": F.when(size < least_samples, "shorter_than_min_window_samples")})


def timed(windows: DataFrame, sfreq: float) -> DataFrame:
    return windows.withColumns({"start_sec": F.col("start_sample") / sfreq, "end_sec": F.col("end_sample") / sfreq, "duration_sec": (F.col("end_sample") - F.col("start_sample")) / sfreq})


def run_windows(labels: DataFrame, sfreq: float, half: int = 3, least_state_ms: float = 80.0, least_window_sec: float = 1.0) -> DataFrame:
    """Windows of regularised runs, with those too short and their reason."""
    by = _keys(labels)
    least = max(1, round(least_state_ms * 1e-3 * sfreq))
    ends = labels.groupBy(*by).agg((F.max("t") + 1).alias("n_times"))
    runs = regularised_runs(labels, half, least).join(ends, by)
    return timed(clip_windows(runs, F.col("n_times"), round(least_window_sec * sfreq)), sfreq).drop("n_times")


def fine_groups(labels: DataFrame, group_samples: int, least_samples: int, size: int = RANGE) -> DataFrame:
    """(subject, grp, n, hardness): the share in percent of a group's samples that lie in runs shorter than ``least_samples``.

    Samples are counted by piece of a run and group first, so a long run is no single task's work.
    """
    by = _keys(labels)
    pieces = _pieces(labels, group_samples, size)
    sizes = pieces.groupBy(*by, "run").agg(F.sum("n").alias("_size"))
    sized = match(pieces, sizes, [*by, "run"])
    short = F.sum(F.when(F.col("_size") < least_samples, F.col("n")).otherwise(0))
    return sized.groupBy(*by, "grp").agg(F.sum("n").alias("n"), (100.0 * short / F.sum("n")).alias("hardness"))


def macro_windows(groups: DataFrame, size: int, stride: int, range_size: int = RANGE) -> DataFrame:
    """(subject, macro, first_group, hardness): means over ``size`` groups, every ``stride`` groups."""
    by = _keys(groups)
    rows = numbered(groups.select(*by, "grp", "hardness"), by, F.col("grp"), ["grp"], "k")
    ahead = Window.partitionBy(*by, "_range").orderBy("k").rowsBetween(0, size - 1)
    held = with_margins(rows, F.col("k"), 0, size - 1, range_size).withColumns({"_mean": F.avg("hardness").over(ahead), "m": F.count("*").over(ahead)}).where("_inside")
    kept = held.where((F.col("k") % stride == 0) & ((F.col("m") == size) | (F.col("k") == 0)))
    return kept.select(*by, F.expr(f"k div {stride}").alias("macro"), F.col("grp").alias("first_group"), F.col("_mean").alias("hardness"))


def segment(labels: DataFrame, sfreq: float, group_sec: float = 5.0, macro: tuple[int, int] = (1, 1), n_clusters: int = 4, least_subtask_sec: float = 10.0, half: int = 3, least_state_ms: float = 80.0) -> DataFrame:
    """(subject, subtask, cluster_id, start_sec, end_sec, hardness_mean) of a subject's protocol.

    Macro windows are clustered by hardness with one-dimensional k-means (ids by ascending mean),
    neighbours of one cluster merge, and a subtask that is too short joins the neighbour with the
    nearest hardness. A subject's macro windows, one number for some seconds each, meet in one task.
    """
    by = _keys(labels)
    least = max(1, round(least_state_ms * 1e-3 * sfreq))
    size, stride = macro
    rows = macro_windows(fine_groups(smooth_labels(labels, half), round(group_sec * sfreq), least), size, stride)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("macro")
        x, width = pdf["hardness"].to_numpy(), stride * group_sec
        ids = kmeans_1d(x, n_clusters)
        parts: list[list] = []
        for k, c, h in zip(pdf["macro"].tolist(), ids.tolist(), x.tolist(), strict=True):
            if parts and parts[-1][0] == c:
                parts[-1][2:] = [(k + 1) * width, parts[-1][3] + h, parts[-1][4] + 1]
            else:
                parts.append([c, k * width, (k + 1) * width, h, 1])
        parts = merge_subtasks(parts, least_subtask_sec)
        return pd.DataFrame([(*key, i, int(p[0]), float(p[1]), float(p[2]), float(p[3] / p[4])) for i, p in enumerate(parts)], columns=[*by, "subtask", "cluster_id", "start_sec", "end_sec", "hardness_mean"])

    kinds = ", ".join(f"{c} string" for c in by)
    return rows.withColumns({c: F.col(c).cast("string") for c in by}).groupBy(*by).applyInPandas(run, f"{kinds}, subtask int, cluster_id int, start_sec double, end_sec double, hardness_mean double")


def merge_subtasks(parts: list[list], least_sec: float) -> list[list]:
    """Parts (cluster, start, end, sum, n) shorter than ``least_sec`` join the neighbour with the nearest mean (the left of equal ones), left to right, until none is left.

    All parts before the one looked at are long enough, so each is looked at once, and once more for each that joins it: the work is in proportion to the parts.
    """
    done: list[list] = []
    ahead = parts[::-1]
    while ahead:
        part = ahead.pop()
        if part[2] - part[1] >= least_sec or not (done or ahead):
            done.append(part)
            continue
        mean = part[3] / part[4]
        left, right = (abs(side[-1][3] / side[-1][4] - mean) if side else np.inf for side in (done, ahead))
        if left <= right:
            c, start, _, total, n = done.pop()
            done.append([c, start, part[2], total + part[3], n + part[4]])
        else:
            c, _, end, total, n = ahead.pop()
            ahead.append([c, part[1], end, part[3] + total, part[4] + n])
    return done


def kmeans_1d(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Cluster ids in order of their means, from centres at even quantiles."""
    centres = np.unique(np.quantile(x, (np.arange(k) + 0.5) / k))
    for _ in range(rounds):
        ids = np.abs(x[:, None] - centres).argmin(axis=1)
        new = np.array([x[ids == c].mean() if (ids == c).any() else centres[c] for c in range(len(centres))])
        if np.array_equal(new, centres):
            break
        centres = new
    return np.unique(np.abs(x[:, None] - centres).argmin(axis=1), return_inverse=True)[1]


def window_signals(recordings: DataFrame, windows: DataFrame, chunk: int = 16_384) -> DataFrame:
    """Each recording's signal cut to each window (subject, window_index, start_sample, end_sample), by task too where windows have one.

    Signals are cut into chunks of so many samples, and windows are dealt to the chunks they cover: what meets is a chunk and a window, and only
    the part of the chunk inside the window goes on, to be put together in order. So no signal is copied for each of its windows, and one recording of many
    windows is many tasks' work. A window's samples outside the recording are left out; a window with none has no row.
    """
    by = [c for c in ("subject", "task") if c in windows.columns]
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("signal") - 1) / F.lit(chunk)).cast("int")), lambda k: F.struct(k.cast("long").alias("bin"), F.slice("signal", k * chunk + 1, F.lit(chunk)).alias("x")))
    rest = [c for c in recordings.columns if c != "signal"]
    cut = recordings.where(F.size("signal") > 0).select(*rest, F.explode(parts).alias("_c")).select(*rest, F.col("_c.bin").alias("_bin"), F.col("_c.x").alias("_x"))
    first, last = (F.floor(F.greatest(x, F.lit(0)) / F.lit(chunk)).cast("long") for x in (F.col("start_sample"), F.col("end_sample") - 1))
    dealt = windows.where(F.col("end_sample") > F.greatest(F.col("start_sample"), F.lit(0))).select(*[F.col(c).alias(f"_{c}") for c in by], "window_index", "start_sample", "end_sample", F.explode(F.sequence(first, last)).alias("_at"))
    joined = cut.join(dealt, [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_bin") == F.col("_at")])
    low, high = (F.greatest(F.least(F.col(c) - F.col("_bin") * chunk, F.size("_x")), F.lit(0)).cast("int") for c in ("start_sample", "end_sample"))
    piece = joined.select(*rest, "window_index", F.struct("_bin", F.slice("_x", low + 1, high - low).alias("x")).alias("_p"))
    whole = piece.groupBy(*rest, "window_index").agg(F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["x"])).alias("signal"))
    return whole.where(F.size("signal") > 0)


def apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """The positions left when, from the highest on, each takes away all closer to it than ``distance``."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(-height[at], kind="stable").tolist():
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near] = False
    return at[keep]


def fit_labels(recordings: DataFrame, n_maps: int = 4, n_runs: int = 25, seed: int = 0, peaks_only: bool = True, n_std: float = 3.0, distance: int = 10) -> DataFrame:
    """What ``labels_fitted`` gives for the recordings it works for."""
    return labels_fitted(recordings, n_maps, n_runs, seed, peaks_only, n_std, distance).good


def labels_fitted(recordings: DataFrame, n_maps: int = 4, n_runs: int = 25, seed: int = 0, peaks_only: bool = True, n_std: float = 3.0, distance: int = 10) -> Outcome:
    """(subject, task, t, label) from maps fitted to a recording's peaks of global field power, whatever their sign.

    Peaks within ``n_std`` deviations of the mean of all and ``distance`` samples apart at least, higher ones first, are clustered by modified k-means;
    of ``n_runs`` the run with most explained variance counts, and every sample takes the map
    with the largest absolute correlation. A group is one recording.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = signals(pdf)[1]
        x = x - x.mean(axis=0)
        power = x.std(axis=0)
        inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] >= power[2:])) + 1
        inner = inner[np.abs(power[inner] - power.mean()) <= n_std * power.std()]
        inner = apart(inner, power, distance)
        at = inner if peaks_only and len(inner) >= n_maps else np.arange(x.shape[1])
        y = x[:, at] / np.maximum(np.linalg.norm(x[:, at], axis=0), 1e-300)
        rng, best = np.random.default_rng(seed), (-1.0, None)
        for _ in range(n_runs):
            maps = y[:, rng.choice(y.shape[1], min(n_maps, y.shape[1]), replace=False)]
            for _ in range(100):
                ids = np.abs(maps.T @ y).argmax(axis=0)
                new = maps.copy()
                for k in range(maps.shape[1]):
                    if (ids == k).any():
                        new[:, k] = np.linalg.svd(y[:, ids == k], full_matrices=False)[0][:, 0]
                if np.allclose(np.abs((new * maps).sum(axis=0)), 1, atol=1e-9):
                    break
                maps = new
            fit = float((np.abs(maps.T @ y).max(axis=0) ** 2 * power[at] ** 2).sum())
            if fit > best[0]:
                best = (fit, maps)
        label = np.abs(best[1].T @ x).argmax(axis=0)
        return pd.DataFrame({"subject": key[0], "task": key[1], "t": np.arange(len(label)), "label": label})

    keyed = recordings.select(F.col("subject").cast("string"), F.col("task").cast("string"), F.col("ch_idx").cast("int"), "signal")
    return guarded(keyed.groupBy("subject", "task"), ["subject", "task"], run, "subject string, task string, t long, label int", "labels")
