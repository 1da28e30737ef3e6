"""Long sequences in ranges, runs in linear time, windows cut from chunks, tapers, and bad recordings beside good ones."""

import itertools
import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecrest import cli
from wavecrest.functions.signal import slepian
from wavecrest.operators import connectivity, learn, quarantine, ranges, windows
from wavecrest.plans import pipelines
from wavecrest.sources import recordings as R

RECORDING = "subject string, task string, ch_idx int, signal array<double>"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# runs


def merged_one_by_one(labels, least):
    """The rule, written plainly: the first short run joins the longer neighbour, the left of equal ones, and all starts again."""
    runs = [[x, len(list(g))] for x, g in itertools.groupby(labels)]
    while len(runs) > 1:
        k = next((k for k, r in enumerate(runs) if r[1] < least), None)
        if k is None:
            break
        left, right = (runs[k - 1][1] if k else -1), (runs[k + 1][1] if k + 1 < len(runs) else -1)
        runs[k][0] = runs[k - 1 if left >= right else k + 1][0]
        runs = [[x, sum(n for _, n in g)] for x, g in itertools.groupby(runs, key=lambda r: r[0])]
    return [x for x, n in runs for _ in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 5)), max_size=25), st.integers(1, 9))
def test_merging_is_the_rule_applied_one_by_one(runs, least):
    labels = [x for x, n in runs for _ in range(n)]
    assert windows.merge_short(labels, least) == merged_one_by_one(labels, least)


def test_a_million_runs_merge_in_seconds():
    rng = np.random.default_rng(1)
    labels, sizes = rng.integers(0, 4, 1_000_000).tolist(), rng.integers(1, 9, 1_000_000).tolist()
    began = time.time()
    found, n = windows.merge_runs(labels, sizes, 20)
    assert time.time() - began < 10
    assert sum(n) == sum(sizes) and min(n) >= 20 and all(a != b for a, b in itertools.pairwise(found))


def subtasks_one_by_one(parts, least):
    """The rule, written plainly: the first short part joins the neighbour with the nearest mean, the left of equal ones, and all starts again."""
    parts = [list(p) for p in parts]
    while len(parts) > 1:
        k = next((k for k, p in enumerate(parts) if p[2] - p[1] < least), None)
        if k is None:
            break
        near = min((j for j in (k - 1, k + 1) if 0 <= j < len(parts)), key=lambda j: abs(parts[j][3] / parts[j][4] - parts[k][3] / parts[k][4]))
        a, b = sorted((k, near))
        parts[a : b + 1] = [[parts[near][0], parts[a][1], parts[b][2], parts[a][3] + parts[b][3], parts[a][4] + parts[b][4]]]
    return parts


def parts_of(hardness):
    return [[c % 3, 5.0 * k, 5.0 * k + 5, 20.0 * c, 1] for k, c in enumerate(hardness)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.integers(1, 40))
def test_subtasks_merge_by_the_rule_applied_one_by_one(hardness, least):
    assert windows.merge_subtasks(parts_of(hardness), least) == subtasks_one_by_one(parts_of(hardness), least)


def test_a_long_protocol_is_segmented_in_seconds(spark):
    rng = np.random.default_rng(1)
    rows = [("s", t, f"e{x}") for t, x in enumerate(rng.integers(0, 2, 100_000).tolist())]
    began = time.time()
    assert windows.segment(spark.createDataFrame(rows, "subject string, t long, label string"), 1.0, 5.0, (1, 1), 3, 10.0, 0, 2000.0).count() > 1_000
    assert time.time() - began < 60


@pytest.fixture(scope="module")
def long_subject(spark):
    """One subject of some 5,000 samples and a short one, with runs from one sample to several ranges of 100 long."""
    rng = np.random.default_rng(3)
    labels = np.repeat(rng.integers(0, 3, 400), rng.choice([1, 2, 3, 9, 350], 400, p=[0.3, 0.3, 0.2, 0.16, 0.04]))[:5000].tolist()
    rows = [("a", t, int(x)) for t, x in enumerate(labels)] + [("b", t, 7) for t in range(3)]
    return spark.createDataFrame(rows, "subject string, t long, label int").repartition(5), labels


def test_a_subject_in_fifty_ranges_has_the_same_runs(long_subject):
    df, labels = long_subject
    want, at = [], 0
    for k, (x, g) in enumerate(itertools.groupby(labels)):
        n = len(list(g))
        want.append(("a", k + 1, x, at, at + n))
        at += n
    want.append(("b", 1, 7, 0, 3))
    columns = ("subject", "run", "label", "start_sample", "end_sample")
    assert rows_of(windows.label_runs(df, 100), *columns) == want == rows_of(windows.label_runs(df), *columns)


def test_a_subject_in_fifty_ranges_is_smoothed_and_grouped_the_same(long_subject):
    df, labels = long_subject
    smooth = rows_of(windows.smooth_labels(df, 4, 100), "subject", "t", "label")
    assert smooth == rows_of(windows.smooth_labels(df, 4), "subject", "t", "label")
    for _, t, x in smooth[: len(labels)]:
        near = labels[max(0, t - 4) : t + 5]
        most = max(near.count(y) for y in near)
        assert x == (labels[t] if near.count(labels[t]) == most else min(y for y in near if near.count(y) == most))
    groups = windows.fine_groups(df, 30, 3, 100)
    assert rows_of(groups, "subject", "grp", "n", "hardness") == rows_of(windows.fine_groups(df, 30, 3), "subject", "grp", "n", "hardness")
    lengths = [len(list(g)) for _, g in itertools.groupby(labels)]
    run_size = [n for n in lengths for _ in range(n)]
    parts = [run_size[k : k + 30] for k in range(0, len(labels), 30)]
    got = {r.grp: r.hardness for r in groups.where("subject = 'a'").collect()}
    assert got == pytest.approx({k: 100 * sum(n < 3 for n in part) / len(part) for k, part in enumerate(parts)})
    macro = ("subject", "macro", "first_group", "hardness")
    assert rows_of(windows.macro_windows(groups, 4, 3, 20), *macro) == rows_of(windows.macro_windows(groups, 4, 3), *macro)


def test_labels_of_two_tasks_do_not_mix(spark):
    df = spark.createDataFrame([("a", "x", 0, 1), ("a", "x", 1, 1), ("a", "y", 0, 2), ("a", "y", 1, None), ("a", "y", 2, None)], "subject string, task string, t long, label int")
    got = {tuple(r) for r in windows.label_runs(df).collect()}
    assert got == {("a", "x", 1, 1, 0, 2), ("a", "y", 1, 2, 0, 1), ("a", "y", 2, None, 1, 3)}


def test_no_window_over_samples_is_by_subject_alone(long_subject):
    plan = windows.smooth_labels(long_subject[0], 4)._jdf.queryExecution().analyzed().toString()
    assert "_range" in plan and "windowspecdefinition(subject#" in plan
    assert not [line for line in plan.splitlines() if "windowspecdefinition(subject#" in line and "_range" not in line]


def test_numbers_go_on_through_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("s"), (F.col("id") * 1000).alias("p")).union(spark.createDataFrame([(0, None)], "s long, p long"))
    got = {(r.s, r.p): r.k for r in ranges.numbered(df, ["s"], F.col("p"), ["p"], "k").collect()}
    assert got == {(0, None): 0} | {(i % 2, i * 1000): i // 2 + (i % 2 == 0) for i in range(1000)}


# windows of signals


def test_windows_are_cut_from_chunks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 5003))
    rec = spark.createDataFrame([("s", t, c, x[c].tolist()) for t in ("u", "v") for c in range(2)] + [("s", "u", 2, []), ("s", "u", 3, None), ("z", "u", 0, [1.0])], RECORDING)
    cuts = [(k, int(a), int(a + n)) for k, (a, n) in enumerate(zip(rng.integers(0, 5100, 10_000), rng.integers(0, 300, 10_000), strict=True))]
    cuts += [(10_000, 0, 5003), (10_001, 5000, 9000), (10_002, 99, 100), (10_003, 100, 101)]
    frame = spark.createDataFrame([("s", *c) for c in cuts], "subject string, window_index int, start_sample long, end_sample long")
    got = {(r.task, r.ch_idx, r.window_index): r.signal for r in windows.window_signals(rec, frame, 100).collect()}
    want = {(t, c, k): x[c, a:b].tolist() for k, a, b in cuts for t in ("u", "v") for c in range(2) if b > a and a < 5003}
    assert got == want
    own = spark.createDataFrame([("s", "v", 0, 3, 8)], "subject string, task string, window_index int, start_sample long, end_sample long")
    assert {(r.task, tuple(r.signal)) for r in windows.window_signals(rec, own).collect()} == {("v", tuple(x[c, 3:8])) for c in range(2)}


# tapers


@pytest.mark.parametrize(("n", "half"), [(64, 4.0), (200, 4.0), (201, 2.5), (5, 4.0), (1, 4.0)])
def test_tapers_are_orthogonal_and_concentrated(n, half):
    tapers, share = slepian(n, half)
    assert np.allclose(tapers @ tapers.T, np.eye(len(tapers)), atol=1e-9)
    assert (np.diff(share) <= 1e-12).all() and (share <= 1 + 1e-9).all()
    if n >= 64:
        assert (share > 0.9).all() and share[0] > 0.9999
        fine = np.abs(np.fft.rfft(tapers, 64 * n)) ** 2  # energy within the band, from the spectrum
        f = np.arange(fine.shape[1]) / (64 * n)
        weight = np.where((f == 0) | (f == 0.5), 1, 2)
        assert np.allclose((fine * weight * (f <= half / n)).sum(axis=1) / (fine * weight).sum(axis=1), share, atol=0.02)


def test_spectral_measures_of_known_signals(spark):
    rng = np.random.default_rng(2)
    t = np.arange(4000) / 100
    a = np.sin(2 * np.pi * 10 * t)
    signals = [a + 0.01 * rng.normal(size=4000), np.sin(2 * np.pi * 10 * t - 1) + 0.01 * rng.normal(size=4000), rng.normal(size=4000)]
    rec = spark.createDataFrame([("s", "u", c, x.tolist()) for c, x in enumerate(signals)], RECORDING)
    got = {(r.i, r.j): r for r in connectivity.spectral_connectivity(rec, 100.0, 9.5, 10.5, diagonal=True).collect()}
    assert got[0, 1].coh > 0.99 and got[0, 1].plv > 0.99 and got[0, 1].wpli > 0.99
    assert got[0, 2].coh < 0.6 and (got[1, 1].wpli, got[1, 1].coh, got[1, 1].plv) == (0.0, 1.0, 1.0)
    only = connectivity.spectral_connectivity(rec, 100.0, 9.5, 10.5, methods=["plv"])
    assert only.columns == ["subject", "task", "i", "j", "plv"] and {(r.i, r.j): r.plv for r in only.collect()} == {k: r.plv for k, r in got.items() if k[0] < k[1]}
    with pytest.raises(ValueError, match="pli"):
        connectivity.spectral_connectivity(rec, 100.0, 8.0, 13.0, methods=["pli"])


# bad recordings beside good ones


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(9)
    good = [("g", t, c, rng.normal(size=400).tolist()) for t in ("1_IDG", "1_rest") for c in range(3)]
    bad = [("empty", "1_IDG", 0, []), ("empty", "1_IDG", 1, [1.0, 2.0]), ("null", "1_IDG", 0, None), ("null", "1_IDG", 1, [1.0])]
    return spark.createDataFrame(good, RECORDING), spark.createDataFrame(good + bad, RECORDING).repartition(3)


@pytest.mark.parametrize(
    ("stage", "form"),
    [
        ("wpli", lambda r: connectivity.phase_lags(r, 100.0)),
        ("mi", connectivity.informations),
        ("spectral connectivity", lambda r: connectivity.spectral_measures(r, 100.0, 8.0, 13.0)),
        ("labels", lambda r: windows.labels_fitted(r, 2, 2)),
    ],
)
def test_a_bad_recording_leaves_the_others_as_they_are(mixed, stage, form):
    alone, beside = form(mixed[0]), form(mixed[1])
    assert isinstance(beside, quarantine.Outcome)
    assert rows_of(beside.good, *beside.good.columns) == rows_of(alone.good, *alone.good.columns) and alone.failed.count() == 0
    told = {(r.subject, r.task, r.stage): r.error for r in beside.failed.collect()}
    assert set(told) == {("empty", "1_IDG", stage), ("null", "1_IDG", stage)}
    assert "channel 0 has no samples" in told["empty", "1_IDG", stage] and "channel 0 has no signal" in told["null", "1_IDG", stage]


def test_a_recording_shorter_than_an_epoch_fails_alone(spark):
    rec = spark.createDataFrame([("s", "short", 0, [1.0] * 10), ("s", "long", 0, [float(k % 7) for k in range(300)]), ("s", "long", 1, [float(k % 5) for k in range(300)])], RECORDING)
    got = connectivity.spectral_measures(rec, 100.0, 8.0, 13.0)
    assert [(r.task, r.error) for r in got.failed.collect()] == [("short", "ValueError: 10 samples are less than an epoch of 200")]
    assert got.good.count() == 1


def test_analyses_tell_which_recordings_are_well(mixed):
    alone, beside = (pipelines.connectivity_analysis(r, 100.0) for r in mixed)
    for name in ("edges", "features", "graphs"):
        assert sorted(map(str, alone[name].collect())) == sorted(map(str, beside[name].collect()))
    assert {(r.subject, r.task): r.ok for r in beside["status"].collect()} == {("g", "1_IDG"): True, ("g", "1_rest"): True, ("empty", "1_IDG"): False, ("null", "1_IDG"): False}
    named = mixed[1].withColumn("channel", F.element_at(F.array(F.lit("F3"), F.lit("F4"), F.lit("Cz")), F.col("ch_idx") + 1))
    tables = pipelines.analyze(named, 100.0, 64)
    assert {r.subject: r.ok for r in tables["status"].collect()} == {"g": True, "empty": False, "null": False}
    assert tables["psd"].where("subject = 'g'").count() == 6
    for measure in ("mi", "coh", "plv"):
        assert pipelines.connectivity_analysis(mixed[1], 100.0, measure=measure)["features"].count() == 2
    kept = pipelines.connectivity_analysis(mixed[0], 100.0, detrend=True, intermediates=True)
    assert kept["analytic"].count() == 6 and "re" in kept["analytic"].columns


def test_a_damaged_file_leaves_the_others_as_they_are(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.json").write_text(json.dumps({"a": [[1, 2], [3, 4]], "flat": [5, 6]}))
    (tmp_path / "in" / "none.json").write_text("{}")
    (tmp_path / "in" / "broken.json").write_text('{"a": [[1, 2')
    (tmp_path / "in" / "words.json").write_text('{"a": "x", "b": [[7]]}')
    (tmp_path / "in" / "bad.mat").write_bytes(b"MATLAB" + bytes(300))
    (tmp_path / "in" / "short.mat").write_bytes(b"x")
    found, failed = pipelines.read(spark, str(tmp_path / "in"))
    assert rows_of(found, "subject", "task", "ch_idx", "signal") == [("good", "a", 0, [1, 2]), ("good", "a", 1, [3, 4]), ("good", "flat", 0, [5, 6]), ("words", "b", 0, [7])]
    assert {(r.subject, r.task) for r in failed.collect()} == {("broken", None), ("words", "a"), ("bad", None), ("short", None)}
    np.save(tmp_path / "good.npy", np.arange(6).reshape(3, 2))
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "good.npy").read_bytes()[:-8])
    got = R.npy_files(spark, str(tmp_path))
    assert rows_of(got.good, "subject", "ch_idx", "signal") == [("good", 0, [0, 2, 4]), ("good", 1, [1, 3, 5])]
    assert {r.subject for r in got.failed.collect()} == {"cube", "cut"}


def test_commands_go_on_beside_a_damaged_file(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    (tmp_path / "in").mkdir()
    for s in ("s1", "s2"):
        (tmp_path / "in" / f"{s}.json").write_text(json.dumps({t: rng.normal(size=(3, 128)).tolist() for t in ("1_rest", "1_idea generation")}))
    (tmp_path / "in" / "s3.json").write_text("{")
    cli.main(["analyze", "--input", str(tmp_path / "in"), "--sfreq", "64", "--nperseg", "64", "--n-channels", "63", "--out-dir", str(tmp_path / "out")])
    assert {(r.subject, r.ok) for r in spark.read.parquet(str(tmp_path / "out" / "status")).collect()} == {("s1", True), ("s2", True), ("s3", False)}
    cli.main(["design-creativity", "--input", str(tmp_path / "in"), "--sfreq", "64", "--n-channels", "63", "--out-dir", str(tmp_path / "dc"), "--detrend", "--save-intermediates", "--no-classification"])
    assert spark.read.parquet(str(tmp_path / "dc" / "features")).count() == 4 and spark.read.parquet(str(tmp_path / "dc" / "analytic")).count() == 12


def test_a_classifier_that_fails_is_told_and_the_others_go_on(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(str(i), "ab"[i % 2], (rng.normal(size=3) + 4 * (i % 2)).tolist()) for i in range(60)] + [("bad", "a", [1.0, None, 2.0]), ("none", None, [1.0, 2.0, 3.0]), ("empty", "b", [])]
    df = spark.createDataFrame(rows, "sample_id string, label string, features array<double>")
    classify = learn.classify
    monkeypatch.setattr(learn, "classify", lambda s, model, *a: 1 / 0 if model == "mlp" else classify(s, model, *a))
    got = pipelines.train_classifiers(df, cv_folds=2)
    assert {r.stage for r in got["failures"].collect()} == {"rows", "mlp"} and "mlp_report" not in got
    for model in ("knn", "svm"):
        summary = got[f"{model}_summary"].first()
        assert summary.accuracy > 0.9 and summary.train_accuracy > 0.9 and summary.cv_mean > 0.9 and summary.n == 12


def test_classifiers_of_nothing_and_of_one_class(spark):
    none = spark.createDataFrame([], "sample_id long, label string, features array<double>, test boolean")
    for model in ("mlp", "svm"):
        assert learn.classify(none, model).count() == 0
    one = spark.createDataFrame([(i, "a", [1.0], i < 2) for i in range(8)], none.schema)
    with pytest.raises(ValueError, match="one class"):
        learn.classify(one, "svm")
