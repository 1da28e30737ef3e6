"""Operators against known values, plain versions and properties."""

import io
import itertools
import json
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecrest import cli
from wavecrest.functions import distributions as D
from wavecrest.functions import signal as G
from wavecrest.functions import spectral as S
from wavecrest.functions.sql import register
from wavecrest.operators import channels, connectivity, learn, spectrum, stats, trp, windows
from wavecrest.plans import pipelines
from wavecrest.sources import recordings as R
from wavecrest.streaming.labels import label_sessions


def sine_pair(spark):
    t = np.arange(4000) / 500
    x = np.sin(2 * np.pi * 10 * t)
    return spark.createDataFrame([("s", "task", 0, "F3", x.tolist()), ("s", "task", 1, "F4", (2 * x).tolist())], "subject string, task string, ch_idx int, channel string, signal array<double>")


def test_sine_pair(spark):
    psd = spectrum.spectra(sine_pair(spark), 500.0, 1024, 512)
    power = {r.channel: r.power for r in spectrum.band_powers(psd, bands={"alpha": (8.0, 13.0)}).collect()}
    assert power["F3"] == pytest.approx(0.50347057, abs=1e-8) and power["F4"] == pytest.approx(2.0138823, abs=1e-7)
    assert spectrum.asymmetry(psd).first().faa == pytest.approx(math.log(4), abs=1e-12)
    assert spectrum.asymmetry(psd, right="O2").first().faa is None
    m = spectrum.metrics(psd).where("channel = 'F3'").first()
    assert m.iaf == pytest.approx(10, abs=0.5) and m.f50 <= m.sef95
    trap = psd.select(S.trapezoid(S.within(F.col("freq"), F.col("p"), 8.0, 13.0)).alias("a")).collect()
    assert [r.a for r in trap] == pytest.approx([0.49998043, 1.99992173], abs=1e-8)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-10, 10), min_size=4, max_size=64))
def test_welch_of_one_boxcar_segment_keeps_the_variance(xs):
    x = np.array(xs)
    f, p = G.welch(x, 1.0, len(x), name="boxcar")
    assert p.sum() / len(x) == pytest.approx(x.var(), abs=1e-9)


def test_simpson_of_few_points(spark):
    ys = [[], [1.0], [1.0, 2.0], [0.0, 1.0, 4.0], [0.0, 1.0, 4.0, 9.0]]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "i int, y array<double>")
    got = [r.v for r in df.select("i", S.simpson(F.col("y"), F.lit(1.0)).alias("v")).orderBy("i").collect()]
    assert got == [None, 0.0, 1.5, pytest.approx(8 / 3), pytest.approx(9)]


def test_bandpass_is_zero_phase_with_known_taps():
    b, a = G.butter_bandpass(8, 13, 500)
    assert b == pytest.approx([0.00094469, 0, -0.00188938, 0, 0.00094469], abs=1e-8)
    assert a == pytest.approx([1, -3.87911361, 5.67485541, -3.71046018, 0.91497583], abs=1e-7)
    x = np.sin(2 * np.pi * 10 * np.arange(5000) / 500)
    y = G.filtfilt(b, a, x)[0]
    assert np.abs(y[1000:4000] - x[1000:4000]).max() < 0.02


def test_analytic_and_savgol():
    t = np.arange(200) / 200
    z = G.analytic(np.cos(2 * np.pi * 5 * t)[None])[0]
    assert np.allclose(z, np.exp(2j * np.pi * 5 * t))
    y = 1 + t - 2 * t**2 + t**3
    assert np.allclose(G.savgol(y), y)


@pytest.mark.parametrize("n", [1, 10, 11, 12, 40])
def test_smoothed_peaks_stay_in_the_jvm(spark, n):
    y = np.random.default_rng(n).uniform(1, 2, n)
    df = spark.createDataFrame([([8 + k / 10 for k in range(n)], y.tolist()), ([], []), (None, None)], "freq array<double>, p array<double>")
    got = df.select(S.smoothed(F.col("p")).alias("y"), S.individual_alpha(F.col("freq"), F.col("p")).alias("iaf"))
    assert "Python" not in got._jdf.queryExecution().toString()
    want = G.savgol(y) if n >= 11 else y
    rows = got.collect()
    assert np.allclose(rows[0].y, want) and rows[0].iaf == (None if n == 1 else 8 + int(want.argmax()) / 10)
    assert rows[1].iaf is None and rows[2].iaf is None


def test_distributions_have_table_values():
    assert D.f_sf(4.2565, 2, 9) == pytest.approx(0.05, abs=1e-4)
    assert D.t_sf2(2.2281, 10) == pytest.approx(0.05, abs=1e-4)
    assert D.tukey_sf(3.877, 3, 10) == pytest.approx(0.05, abs=1e-3)
    assert D.tukey_sf(3.314, 3, 1e6) == pytest.approx(0.05, abs=1e-3)
    assert D.tukey_sf(2.2281 * math.sqrt(2), 2, 10) == pytest.approx(0.05, abs=1e-4)


def test_functions_in_sql(spark):
    register(spark)
    x = np.sin(2 * np.pi * 10 * np.arange(1000) / 100)
    spark.createDataFrame([(x.tolist(),), (None,)], "x array<double>").createOrReplaceTempView("signals")
    r = spark.sql("SELECT f_sf(4.2565D, 2D, 9D) AS f, t_sf(2.2281D, 10D) AS t, tukey_sf(3.877D, 3D, 10D) AS q, f_sf(NULL, 1D, 1D) AS n").first()
    assert (r.f, r.t, r.q) == (pytest.approx(0.05, abs=1e-4), pytest.approx(0.05, abs=1e-4), pytest.approx(0.05, abs=1e-3)) and r.n is None
    rows = spark.sql("SELECT x, welch_psd(x, 100, 200) AS s, bandpass_analytic(x, 8, 13, 100) AS z, savgol(x) AS y FROM signals").collect()
    got, none = sorted(rows, key=lambda r: r.x is None)
    f, p = G.welch(x, 100.0, 200)
    assert np.allclose(got.s.freq, f) and np.allclose(got.s.p, p) and np.allclose(got.y, G.savgol(x))
    assert np.allclose(np.hypot(got.z.re, got.z.im)[300:700], 1, atol=0.05)
    assert none.s.freq is None and none.y is None


def test_stats_of_groups(spark):
    rows = [(g, "x", v) for g, vs in {"a": [1, 2, 3], "b": [2, 3, 4], "c": [7, 8, 9]}.items() for v in map(float, vs)]
    got = stats.statistical_analysis(spark.createDataFrame(rows, "label string, feature string, value double"))
    a = got["anova"].first()
    assert (a.f, a.df_b, a.df_w) == (pytest.approx(31), 2, 6) and a.eta2 == pytest.approx(62 / 68)
    pairs = {(r.g1, r.g2): r for r in got["pairwise"].collect()}
    assert pairs["a", "b"].q == pytest.approx(math.sqrt(3)) and not pairs["a", "b"].significant and pairs["a", "c"].significant and pairs["a", "c"]["diff"] == 6
    t = {(r.g1, r.g2): r for r in stats.bonferroni(stats.group_stats(spark.createDataFrame(rows, "label string, feature string, value double"))).collect()}
    assert t["a", "c"]["diff"] == -6 and t["a", "c"].significant


def test_cz(spark):
    x = np.random.default_rng(42).normal(size=(63, 20))
    rec = spark.createDataFrame([("s", "t", k, r.tolist()) for k, r in enumerate(x)] + [("s64", "t", 0, [1.0])], "subject string, task string, ch_idx int, signal array<double>")
    after = channels.interpolate_cz(rec)
    checked = channels.verify_cz(rec.where("subject = 's'"), after.where("subject = 's'")).collect()
    assert len(checked) == 3 and all(r.ok for r in checked)
    wrong = after.where("subject = 's'").withColumn("signal", F.when(F.col("ch_idx") == 30, F.slice("signal", 1, 5)).otherwise(F.col("signal")))
    assert {r.block: r.ok for r in channels.verify_cz(rec.where("subject = 's'"), wrong).collect()} == {"before": True, "cz": True, "after": False}
    cz = after.where("ch_idx = 23 and subject = 's'").first().signal
    assert np.allclose(cz, x[list(channels.CZ_NEIGHBOURS)].mean(axis=0), atol=1e-12)
    assert "Generate" not in after._jdf.queryExecution().executedPlan().toString()
    assert after.where("subject = 's64'").count() == 1


def test_wpli_and_graph(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5, 300))
    rec = spark.createDataFrame([("s", "t", k, r.tolist()) for k, r in enumerate(x)], "subject string, task string, ch_idx int, signal array<double>")
    edges = connectivity.phase_lag_edges(rec, 100.0, 8.0, 13.0)
    z = G.analytic(G.filtfilt(*G.butter_bandpass(8, 13, 100), x))
    for r in edges.collect():
        im = np.imag(z[r.i] * np.conj(z[r.j]))
        assert r.w == pytest.approx(abs(im.mean()) / np.abs(im).mean(), abs=1e-12) and 0 <= r.w <= 1
    kept = connectivity.analytic_signals(rec, 100.0, 8.0, 13.0).orderBy("ch_idx").collect()
    assert np.allclose([r.re for r in kept], z.real) and np.allclose([r.im for r in kept], z.imag)
    both = connectivity.spectral_connectivity(rec, 100.0, 8.0, 13.0).collect()
    assert len(both) == 10 and all(0 <= v <= 1 + 1e-12 for r in both for v in (r.wpli, r.coh, r.plv))
    assert len(connectivity.graph_features(edges, 0.2).first().features) == 10


def test_mutual_information_by_subject(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 3, 100))
    x[1, 2] = 4.0
    rows = [(s, "t", k, x[i, k].tolist()) for i, s in enumerate(("a", "b")) for k in range(3)]
    rec = spark.createDataFrame(rows, "subject string, task string, ch_idx int, signal array<double>")

    def entropy(*cells):
        n = np.unique(np.stack(cells), axis=1, return_counts=True)[1] / 100
        return -(n * np.log2(n)).sum()

    got = {(r.subject, r.i, r.j): r.w for r in connectivity.mutual_information(rec).collect()}
    assert len(got) == 12
    for (s, i, j), w in got.items():
        a, b = (np.digitize(v, np.histogram_bin_edges(v, 10)[1:-1]) for v in (x["ab".index(s), i], x["ab".index(s), j]))
        assert w == pytest.approx(entropy(a) + entropy(b) - entropy(a, b), abs=1e-9)
    found = pipelines.connectivity_analysis(rec.withColumn("task", F.lit("1_rest")), measure="mi", least=0.5)
    assert found["edges"].where("i >= j").count() == 0 and found["edges"].count() == 6 and len(found["features"].first().features) == 6
    m = found["matrix"].where("subject = 'a'").first()
    assert m.nodes == [0, 1, 2] and m.matrix[0][1] == m.matrix[1][0] == pytest.approx(got["a", 0, 1]) and m.matrix[2][2] == 0


def test_graph_summary_and_top_nodes(spark):
    rows = [("s", "a", 0, 1, 0.9), ("s", "a", 1, 2, 0.1), ("s", "a", 0, 2, 0.3), ("s", "b", 0, 1, 0.9), ("s", "b", 1, 2, 0.1), ("s", "b", 0, 2, 0.1)]
    edges = spark.createDataFrame(rows, connectivity.EDGES)
    assert {r.task: (r.n_edges, round(r.density, 3), r.connected) for r in connectivity.graph_summary(edges).collect()} == {"a": (2, 0.667, True), "b": (1, 0.333, False)}
    top = connectivity.top_nodes(connectivity.strength(edges), "strength", 2).where("task = 'a'").orderBy("rank").collect()
    assert [r.node for r in top] == [0, 1]


def test_detrended_phase_lag_ignores_lines(spark):
    x = np.random.default_rng(3).normal(size=(3, 200))
    t = np.arange(200.0)
    rec = [spark.createDataFrame([("s", "t", k, (r + k * slope * t).tolist()) for k, r in enumerate(G.linear_detrend(x))], "subject string, task string, ch_idx int, signal array<double>") for slope in (0.0, 3.0)]
    a, b = ([r.w for r in connectivity.phase_lag_edges(d, 100.0, None, None, detrend=True).orderBy("i", "j").collect()] for d in rec)
    assert a == pytest.approx(b, abs=1e-9)


def test_classifiers_learn_and_are_cross_validated(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        x = rng.normal(size=2)
        r = 0.5 if i % 2 else 2.5
        rows.append((i, "inner" if i % 2 else "outer", (x / np.linalg.norm(x) * (r + rng.normal() * 0.1)).tolist()))
    features = spark.createDataFrame(rows, "sample_id long, label string, features array<double>")
    got = pipelines.train_classifiers(features, cv_folds=2)
    assert set(got) == {f"{m}_{w}" for m in ("knn", "mlp", "svm") for w in ("confusion", "report", "folds", "summary")}
    for model in ("knn", "svm", "mlp"):
        s = got[f"{model}_summary"].first()
        assert s.n == 48 and s.accuracy > 0.9 and s.cv_mean > 0.9 and 0 <= s.cv_std < 0.1, (model, s)  # no line parts the rings
        assert got[f"{model}_report"].agg(F.sum("support")).first()[0] == 48
        assert sorted(r.n for r in got[f"{model}_folds"].collect()) == [96, 96]


def test_splits_rank_labels_in_order(spark):
    rows = spark.range(500).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("label"))
    md5 = {i: __import__("hashlib").md5(f"{i}:42".encode()).hexdigest() for i in range(500)}
    test = {r.sample_id for r in learn.split(rows).where("test").collect()}
    fold = {r.sample_id: r.fold for r in learn.folds(rows).collect()}
    for label in range(3):
        order = sorted((i for i in range(500) if i % 3 == label), key=lambda i: md5[i])
        assert {i for i in test if i % 3 == label} == set(order[: math.ceil(len(order) * 0.2)])
        assert [fold[i] for i in order] == [k % 5 for k in range(len(order))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=15, max_size=15))
def test_betweenness_counts_shortest_paths(ws):
    n, edges = 6, [(i, j, float(w)) for (i, j), w in zip(itertools.combinations(range(6), 2), ws, strict=True) if w]
    length = {(a, b): d for i, j, d in edges for a, b in ((i, j), (j, i))}
    want = [0.0] * n
    for s, e in itertools.combinations(range(n), 2):
        paths = [(s, *mid, e) for k in range(n - 1) for mid in itertools.permutations([v for v in range(n) if v not in (s, e)], k)]
        known = [(sum(length[p] for p in itertools.pairwise(x)), x) for x in paths if all(p in length for p in itertools.pairwise(x))]
        best = [x for d, x in known if d == min(d for d, _ in known)]
        for x in best:
            for v in x[1:-1]:
                want[v] += 1 / len(best)
    assert connectivity.brandes(n, edges) == pytest.approx(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6))
def test_merged_runs_are_long_enough(labels, least):
    out = windows.merge_short(labels, least)
    runs = [len(list(g)) for _, g in itertools.groupby(out)]
    assert len(out) == len(labels) and set(out) <= set(labels)
    assert len(runs) <= 1 or min(runs) >= least


def dynamic(spark):
    t = np.arange(2000) / 100
    x = np.sin(2 * np.pi * 10 * t)
    rec = spark.createDataFrame([("s", "task", 0, "F3", x.tolist()), ("s", "task", 1, "F4", (2 * x).tolist())], "subject string, task string, ch_idx int, channel string, signal array<double>")
    labels = spark.createDataFrame([("s", i, int(v)) for i, v in enumerate(np.repeat([0, 1, 0, 2], 500))], "subject string, t long, label int")
    return rec, labels


def test_dynamic_windows(spark):
    rec, labels = dynamic(spark)
    got = pipelines.dynamic_windows(rec, labels, 100.0, "run", 128, 1.0, 0, 10.0)
    assert [(r.start_sample, r.end_sample) for r in got["windows"].orderBy("start_sample").collect()] == [(0, 500), (500, 1000), (1000, 1500), (1500, 2000)]
    assert got["metrics"].count() == 8 and got["skipped"].count() == 0
    sub = pipelines.dynamic_windows(rec, labels, 100.0, "subtask", 128, 1.0, 0, 10.0, "none", 1.0, (2, 2), 2, 0.0)
    assert sub["windows"].count() >= 1
    fitted = windows.fit_labels(rec, 1, 2)
    assert fitted.count() == 2000


def test_labels_and_recordings_count_as_far_as_both_go(spark):
    rec, labels = dynamic(spark)
    longer = labels.union(spark.createDataFrame([("s", 2000 + i, 5) for i in range(300)], "subject string, t long, label int"))
    got = pipelines.dynamic_windows(rec, longer, 100.0, "run", 128, 6.0, 0, 10.0)
    assert got["windows"].count() == 0
    assert [(r["index"], r.start_sample, r.end_sample, r.reason) for r in got["skipped"].orderBy("index").collect()] == [(k, 500 * k, 500 * k + 500, "shorter_than_min_window_samples") for k in range(4)]
    assert pipelines.dynamic_windows(None, longer, 100.0, "run", 128, 1.0, 0, 10.0)["windows"].agg(F.max("end_sample")).first()[0] == 2300
    psd = pipelines.dynamic_windows(rec, longer, 100.0, "run", 128, 1.0, 0, 10.0)
    assert [round(r.faa, 6) for r in psd["faa"].orderBy("window_index").collect()] == [round(math.log(4), 6)] * 4


def test_peaks_are_apart():
    height = np.array([0, 5, 4, 6, 0, 3, 0, 1.0])
    assert windows.apart(np.array([1, 2, 3, 5, 7]), height, 2).tolist() == [1, 3, 5, 7]
    assert windows.apart(np.array([1, 2, 3, 5, 7]), height, 3).tolist() == [3, 7]


def test_segments_cover_the_protocol(spark):
    labels = spark.createDataFrame([("s", i, int(v)) for i, v in enumerate(np.random.default_rng(0).integers(0, 4, 5000))], "subject string, t long, label int")
    parts = windows.segment(labels, 500.0, 1.0, (2, 2), 3, 0.0, 0, 10.0).orderBy("start_sec").collect()
    assert parts[0].start_sec == 0 and parts[-1].end_sec == 10 and all(a.end_sec == b.start_sec for a, b in itertools.pairwise(parts))


def test_trp_rules(spark):
    rows = [("s", t, b, 0, p) for t, p in (("rest", 2.0), ("a_task", 8.0)) for b in ("lower_alpha",)]
    powers = spark.createDataFrame(rows, "subject string, task string, band string, ch_idx int, power double")
    for mode, want in (("logratio", math.log10(4)), ("ln", math.log(4)), ("db", 10 * math.log10(4)), ("ratio", 3.0)):
        assert trp.task_related_power(powers, mode, None).first().trp == pytest.approx(want)
    assert trp.task_related_power(powers, baseline="1_rest").count() == 0
    with pytest.raises(ValueError):
        trp.task_related_power(powers, "x", "rest")
    assert trp.parse_merges(["New=a,b*"], ["b1", "a", "b2", "c"]) == {"New": ["a", "b1", "b2"]}
    for bad in ("New", "New=z*"):
        with pytest.raises(ValueError):
            trp.parse_merges([bad], ["a"])
    assert trp.band_keys(["theta", "8-10", "Alpha_High"]) == ("8-10", "Alpha_High") and trp.band_keys([], "a", "b") == ("a", "b")
    with pytest.raises(ValueError):
        trp.band_keys(["lower_alpha"], "a")
    names = {"LogRatio": "logratio", "ln-ratio": "logratio", "LN": "log", "log10_ratio": "log10", "Decibel": "db", "r": "ratio", "Other": "other"}
    assert {k: trp.canonical_mode(k) for k in names} == names
    forms = {("ratio", "db"): "db", ("ratio", "log10"): "log10", ("r", "logratio"): "log", ("ratio", "ln"): "log", ("ratio", "ratio"): "none", ("logratio", "db"): "none", ("db", "log"): "none"}
    assert {k: trp.auto_transform(*k) for k in forms} == forms
    df = spark.createDataFrame([("XY1",), ("FC3",), ("CPz",)], "c string")
    assert [(r.r, r.h) for r in df.select(channels.region(F.col("c")).alias("r"), channels.hemisphere(F.col("c")).alias("h")).collect()] == [("central", "LH"), ("frontal", "LH"), ("central", "MID")]


def test_task_classes(spark):
    df = spark.createDataFrame([("1_idea generation",), ("2_IDE",), ("x",)], "task string")
    assert [r.c for r in df.select(learn.task_class(F.col("task")).alias("c")).collect()] == ["IDG", "IDE", None]
    assert df.select(learn.task_class(F.col("task"), legacy=True).alias("c")).first().c == "IDE"


def mat_file(variables):
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)

    out = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for k, (name, x) in enumerate(variables.items()):
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *x.shape)) + element(1, name.encode()) + element(9, x.astype("<f8").tobytes(order="F"))
        matrix = element(14, body)
        if k % 2:
            packed = zlib.compress(matrix)
            matrix = struct.pack("<II", 15, len(packed)) + packed
        out += matrix
    return out


def test_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "s1.json").write_text(json.dumps({"a": [[1, 2], [3, 4]], "b": [5, 6]}))
    got = sorted((r.subject, r.task, r.ch_idx, list(r.signal)) for r in R.read_task_json(spark, str(tmp_path / "j")).collect())
    assert got == [("s1", "a", 0, [1.0, 2.0]), ("s1", "a", 1, [3.0, 4.0]), ("s1", "b", 0, [5.0, 6.0])]
    x = np.arange(12.0).reshape(3, 4)
    (tmp_path / "Creativity_Sub_7.mat").write_bytes(mat_file({"Creativity_7_1_IDG": x, "Creativity_7_RST2": x + 1, "other": x}))
    got = {(r.subject, r.task, r.ch_idx): list(r.signal) for r in R.read_mat(spark, str(tmp_path / "*.mat")).collect()}
    assert got["7", "1_IDG", 1] == [4, 5, 6, 7] and got["7", "2_rest", 0] == [1, 2, 3, 4] and len(got) == 6
    raw = io.BytesIO()
    np.save(raw, np.array([[1, 2], [3, 4], [5, 6]]))
    (tmp_path / "e.npy").write_bytes(raw.getvalue())
    assert sorted((r.ch_idx, list(r.signal)) for r in R.read_npy(spark, str(tmp_path / "e.npy")).collect()) == [(0, [1, 3, 5]), (1, [2, 4, 6])]
    (tmp_path / "m.locs").write_text("# c\n1 0 0.5 Fp1\n\n2, 0, 0.5, Cz\n")
    assert [r.channel for r in R.read_locs(spark, str(tmp_path / "m.locs")).orderBy("ch_idx").collect()] == ["Fp1", "Cz"]
    (tmp_path / "m.csv").write_text("A, B")
    assert [r.channel for r in R.read_channels(spark, str(tmp_path / "m.csv")).orderBy("ch_idx").collect()] == ["A", "B"]
    rec = R.read_task_json(spark, str(tmp_path / "j"))
    assert {r.channel for r in R.with_channels(rec, R.parse_channels(spark, "X,Y")).where("task = 'a'").collect()} == {"X", "Y"}
    assert {r.channel for r in R.with_channels(rec, R.montage(spark)).collect()} == {"Ch1", "Ch2"}
    (tmp_path / "t" / "s1").mkdir(parents=True)
    (tmp_path / "t" / "s1" / "trp_1_rest.json").write_text(json.dumps({"baseline": "1_rest", "mode": "db", "bands": {"a": {"lower_alpha": [1.0, 2.0]}}}))
    assert [(r.subject, r.task, r.band, r.ch_idx, r.value) for r in R.read_trp_summaries(spark, str(tmp_path / "t")).orderBy("ch_idx").collect()] == [("s1", "a", "lower_alpha", 0, 1.0), ("s1", "a", "lower_alpha", 1, 2.0)]


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "in").mkdir()
    for s in ("s1", "s2"):
        tasks = {f"{k}_{t}": rng.normal(size=(63, 128)).tolist() for k, t in ((1, "rest"), (1, "idea generation"))}
        (tmp_path / "in" / f"{s}.json").write_text(json.dumps(tasks))
    cli.main(["analyze", "--input", str(tmp_path / "in"), "--sfreq", "64", "--nperseg", "64", "--out-dir", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out" / "trp")).count() == 2 * 6 * 64
    assert spark.read.parquet(str(tmp_path / "out" / "faa")).where("faa is not null").count() == 4
    values = spark.read.parquet(str(tmp_path / "out" / "trp"))
    table = pipelines.plot_table(values, R.montage(spark, R.CHANNELS_64), layout="hemi", merges=["ideas=*idea*"], only_merged=True)
    assert {r.x for r in table.collect()} == set(range(1, 11)) and {r.task for r in table.collect()} == {"ideas"}
    cli.main(["design-creativity", "--input", str(tmp_path / "in"), "--sfreq", "64", "--out-dir", str(tmp_path / "dc"), "--no-classification"])
    assert spark.read.parquet(str(tmp_path / "dc" / "features")).count() == 4
    cli.main(["statistical-analysis", "--results-dir", str(tmp_path / "dc"), "--pairwise", "bonferroni"])
    assert spark.read.parquet(str(tmp_path / "dc" / "statistics" / "anova")).count() == 128
    np.save(tmp_path / "l.npy", np.repeat([0, 1, 0, 2], 500))
    np.save(tmp_path / "e.npy", rng.normal(size=(2000, 2)))
    cli.main(["dynamic-window", "--mode", "run", "--sfreq", "100", "--out-dir", str(tmp_path / "dw"), "--labels-npy", str(tmp_path / "l.npy"), "--eeg-npy", str(tmp_path / "e.npy"), "--nperseg", "128"])
    assert spark.read.parquet(str(tmp_path / "dw" / "metrics")).count() == 8
    assert spark.read.parquet(str(tmp_path / "dw" / "faa")).where("faa is null").count() == 4
    cli.main(["dynamic-window", "--mode", "run", "--sfreq", "100", "--out-dir", str(tmp_path / "dw0"), "--labels-npy", str(tmp_path / "l.npy")])
    assert spark.read.parquet(str(tmp_path / "dw0" / "windows")).count() == 4 and not (tmp_path / "dw0" / "metrics").exists()
    cli.main(["dynamic-window", "--mode", "run", "--sfreq", "64", "--out-dir", str(tmp_path / "dw1"), "--input", str(tmp_path / "in"), "--task", "1_rest", "--min-window-sec", "0.1", "--ms-all-samples", "--save-psd"])
    assert spark.read.parquet(str(tmp_path / "dw1" / "computed_labels")).count() == 128 and (tmp_path / "dw1" / "psd").exists()
    cli.main(["convert-json", "--input", str(tmp_path / "in"), "--out-dir", str(tmp_path / "cj")])
    again = pipelines.load(spark, str(next((tmp_path / "cj").glob("subject=s1/*.txt")).rename(tmp_path / "again.json")))
    assert again.count() == 2 * 64
    for k, mode in enumerate(("ratio", "db")):
        folder = tmp_path / "sum" / f"p{k}"
        folder.mkdir(parents=True)
        bands = {b: {c: [2.0, 4.0] for c in R.CHANNELS_64} for b in ("8-10", "10-12", "theta")}
        one = {"mode": mode, "baseline": "1_rest"} | ({"by_channel": {"x": bands}} if k else {"bands": {"x": {b: [1.0] * 64 for b in ("8-10", "10-12", "theta")}}})
        (folder / "trp_1_rest.json").write_text(json.dumps(one))
    cli.main(["plot-trp", "--summary-dir", str(tmp_path / "sum"), "--summary", str(tmp_path / "sum" / "p0" / "trp_1_rest.json"), "--mode", "db", "--out-dir", str(tmp_path / "plot"), "--exclude-midline"])
    plot = spark.read.parquet(str(tmp_path / "plot" / "plot")).collect()
    assert {r.band for r in plot} == {"8-10", "10-12"} and all(r.n == 3 and r["mean"] == pytest.approx(10 * math.log10(8) / 3) for r in plot)
    cli.main(["segment-protocol", "--sfreq", "100", "--out-dir", str(tmp_path / "sp"), "--labels-npy", str(tmp_path / "l.npy")])
    assert spark.read.parquet(str(tmp_path / "sp" / "segments")).count() >= 1


def test_label_sessions(spark):
    rows = [("s", "a", "2024-01-01 00:00:00"), ("s", "a", "2024-01-01 00:30:00"), ("s", "a", "2024-01-01 02:00:00"), ("s", "b", "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "subject string, label string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.label, r.n) for r in label_sessions(df).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nearest_in_many_blocks(spark):
    from wavecrest.operators import learn

    rng = np.random.default_rng(5)
    x, label = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(300)], "sample_id long, label int, features array<double>")
    got = dict(map(tuple, learn.nearest(rows.where("sample_id >= 60"), rows.where("sample_id < 60"), block_rows=16).collect()))
    for i in range(60):
        d = ((x[60:] - x[i]) ** 2).sum(axis=1)
        near = np.lexsort((np.arange(60, 300), d))[:5] + 60
        assert got[i] == np.bincount(label[near]).argmax(), i


def test_label_sessions_of_a_stream(spark, tmp_path):
    rows = [("s", "a", "2024-01-01 00:00:00"), ("s", "a", "2024-01-01 00:30:00"), ("s", "b", "2024-01-01 00:10:00"), ("s", "a", "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "subject string, label string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = label_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events")))
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    # the last session is still open when the stream ends
    assert sorted((r.label, r.n) for r in spark.table("sessions").collect()) == [("a", 2), ("b", 1)]
