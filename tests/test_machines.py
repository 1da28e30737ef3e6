"""Support vector machines against their optimality conditions and a plain solver."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecrest.operators import learn
from wavecrest.operators import machines as M


def two_rings(n, seed=0, noise=0.15):
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 2, 1.0, -1.0)
    angle = rng.uniform(0, 2 * np.pi, n)
    radius = np.where(y > 0, 1.0, 1.6) + rng.normal(0, noise, n)
    return np.c_[radius * np.cos(angle), radius * np.sin(angle)], y


def value(k, y, alpha):
    v = alpha * y
    return alpha.sum() - v @ k @ v / 2


def plain(k, y, c, steps=20_000):
    """Projected gradient; the projection onto the box and the line by bisection."""
    alpha, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(k)[-1]
    for _ in range(steps):
        z = alpha + rate * (1 - y * (k @ (alpha * y)))
        lo, hi = -1e3, 1e3
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (np.clip(z - mid * y, 0, c) * y).sum() > 0 else (lo, mid)
        alpha = np.clip(z - lo * y, 0, c)
    return alpha


@settings(deadline=None, max_examples=40)
@given(st.integers(2, 120), st.integers(0, 10_000), st.sampled_from([0.1, 1.0, 10.0]), st.floats(0.0, 0.6))
def test_solutions_are_optimal(n, seed, c, noise):
    x, y = two_rings(n, seed, noise)
    k = M.kernel(x, x, 0.7)
    alpha, bias = M.solve_dual(k, y, c)
    assert (alpha >= 0).all() and (alpha <= c).all() and abs((alpha * y).sum()) < 1e-9 * max(1, n * c)
    margin = y * (k @ (alpha * y) + bias)
    assert (margin[alpha == 0] >= 1 - 2e-3).all() and (margin[alpha == c] <= 1 + 2e-3).all() and np.allclose(margin[(alpha > 0) & (alpha < c)], 1, atol=2e-3)


@pytest.mark.parametrize("c", [0.5, 1.0, 5.0])
def test_a_plain_solver_finds_the_same(c):
    x, y = two_rings(40, 3, 0.3)
    k = M.kernel(x, x, 0.7)
    alpha, _ = M.solve_dual(k, y, c, 1e-6)
    other = plain(k, y, c, 4_000)
    assert value(k, y, alpha) == pytest.approx(value(k, y, other), rel=1e-4) and value(k, y, alpha) >= value(k, y, other) - 1e-8


def test_repeated_rows_and_one_label():
    k = np.ones((4, 4))
    alpha, bias = M.solve_dual(k, np.array([1.0, -1.0, 1.0, -1.0]))
    assert abs((alpha * [1, -1, 1, -1]).sum()) < 1e-12 and np.isfinite(bias)
    assert M.solve_dual(np.ones((2, 2)), np.ones(2))[0].tolist() == [0, 0]


def samples(spark, x, labels):
    return spark.createDataFrame([(i, int(v), [float(f) for f in row]) for i, (row, v) in enumerate(zip(x, labels, strict=True))], "sample_id long, _y int, features array<double>")


def test_a_cascade_of_blocks_is_the_machine_of_all_rows(spark):
    x, y = two_rings(600, 5)
    df = samples(spark, x, (y < 0).astype(int))
    whole = M.fit(df, 2, 0.7, block_rows=10_000, tol=1e-5)
    cascade = M.fit(df, 2, 0.7, block_rows=50, tol=1e-5)
    k = M.kernel(x, x, 0.7)
    alpha, bias = M.solve_dual(k, y, 1.0, 1e-5)
    exact = k @ (alpha * y) + bias
    for m in (whole, cascade):
        assert len(m.vectors) < 300
        got = np.concatenate([g for _, _, g in m.margins(x)])
        assert np.abs(got - exact).max() < 2e-3
    bounded = M.fit(df, 2, 0.7, block_rows=50, most_support=40)
    assert len(bounded.vectors) <= 40 and ((bounded.votes(x, 2) == 1) == (y < 0)).mean() > 0.9


def test_pairs_of_three_labels_one_of_them_rare(spark):
    rng = np.random.default_rng(7)
    labels = np.r_[np.zeros(300, int), np.ones(90, int), np.full(4, 2)]
    x = np.array([[0, 0], [3, 0], [0, 3]])[labels] + rng.normal(0, 0.4, (len(labels), 2))
    m = M.fit(samples(spark, x, labels), 3, 0.5, block_rows=64)
    assert [p[:2] for p in m.pairs] == [(0, 1), (0, 2), (1, 2)]
    assert (m.votes(x, 3) == labels).mean() > 0.99
    named = M.fit(samples(spark, x, labels).withColumn("sample_id", F.concat(F.lit("s/"), "sample_id")), 3, 0.5, block_rows=16)
    assert (named.votes(x, 3) == labels).mean() > 0.99
    df = samples(spark, x, labels).selectExpr("sample_id", "concat('l', _y) as label", "features", "sample_id % 5 = 0 as test")
    said = learn.classify(df, "svm").collect()
    assert len(said) == 79 and sum(r.label == r.predicted for r in said) >= 78


def test_margins_of_one_label_are_those_of_its_pairs():
    rng = np.random.default_rng(0)
    places = [(a, b, np.sort(rng.permutation(60)[:20]), rng.choice([-1, 1], 20) * rng.uniform(0.1, 1, 20), 0.1) for a, b in ((0, 1), (0, 2), (1, 2))]
    m, x = M.Machines(rng.normal(size=(60, 4)), places, 0.3), rng.normal(size=(9, 4))
    want = [M.kernel(x, m.vectors[own], 0.3) @ w + bias for *_, own, w, bias in places]
    for label, pairs in ((0, [0, 1]), (1, [0, 2]), (2, [1, 2])):
        got = {p: margin for _, p, margin in m.margins(x, [m.of_label(label)])}
        assert sorted(got) == pairs and all(np.allclose(got[p], want[p], atol=1e-12) for p in pairs)
    assert all(np.allclose(margin, want[p], atol=1e-12) for _, p, margin in m.margins(x))


def test_blocks_of_a_kernel_that_is_never_whole_are_the_machine_of_all_rows():
    x, y = two_rings(500, 2, 0.4)
    alpha, _ = M.solve_dual(M.kernel(x, x, 0.7), y, 1.0, 1e-6)
    got = M.settle(x, y, 0.7, np.zeros(500), y, 1.0, 1e-6, 40)
    k = M.kernel(x, x, 0.7)
    assert abs((got * y).sum()) < 1e-9 and value(k, y, got) == pytest.approx(value(k, y, alpha), rel=1e-6)


def noise(labels, per_label, seed=0):
    """Rows whose labels no machine can tell, so that nearly all are support vectors."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(labels * per_label, 8)), np.arange(labels * per_label) % labels


@pytest.mark.parametrize("task_rows", [120, 10_000])
def test_all_rows_of_all_pairs_meet_the_conditions_however_many_support_vectors_there_are(spark, task_rows):
    """Blocks and tasks of fewer rows than a pair has support vectors; the conditions are checked on every row by a plain product."""
    x, labels = noise(3, 130)
    found = M.learned(samples(spark, x, labels), 3, 0.1, block_rows=60, task_rows=task_rows)
    support = {r.sample_id: r.w for r in found.support.collect()}
    w = np.array([support.get(i, [0.0] * 3) for i in range(len(x))])
    k = M.kernel(x, x, 0.1)
    for (a, b), bias in found.bias.items():
        own = np.flatnonzero((labels == a) | (labels == b))
        y = np.where(labels[own] == a, 1.0, -1.0)
        alpha = np.where(labels[own] == a, w[own, b], w[own, a]) * y
        assert (alpha > 0).sum() > 150 and abs((alpha * y).sum()) < 1e-9 and (alpha >= 0).all() and (alpha <= 1).all()
        margin = y * (k[np.ix_(own, own)] @ (alpha * y) + bias)
        assert (margin[alpha == 0] >= 1 - 2e-3).all() and (margin[alpha == 1] <= 1 + 2e-3).all() and np.allclose(margin[(alpha > 0) & (alpha < 1)], 1, atol=2e-3)
    won = np.zeros((len(x), 3), int)
    for (a, b), bias in found.bias.items():
        margin = k @ np.where(labels == a, w[:, b], np.where(labels == b, w[:, a], 0.0)) + bias
        won[margin > 0, a] += 1
        won[margin <= 0, b] += 1
    said = {r.sample_id: r._p for r in M.predicted(samples(spark, x, labels), found).collect()}
    assert [said[i] for i in range(len(x))] == won.argmax(axis=1).tolist()


def test_no_bound_drops_support_vectors_of_a_report(spark):
    """More support vectors of a pair than the 2,048 that a model once kept: held-out rows get the votes of the machine of all rows."""
    x, labels = noise(2, 1_500, 1)
    df = samples(spark, x, labels).selectExpr("sample_id", "_y as label", "features", "sample_id < 300 as test")
    said = {r.sample_id: r.predicted for r in learn.classify(df, "svm").collect()}
    own, y = x[300:], np.where(labels[300:] == 0, 1.0, -1.0)
    gamma = 1 / (8 * own.var())
    alpha, bias = M.solve_dual(M.kernel(own, own, gamma), y, 1.0, 1e-5)
    assert (alpha > 0).sum() > 2_048
    margin = M.kernel(x[:300], own, gamma) @ (alpha * y) + bias
    sure = np.abs(margin) > 5e-3
    assert sure.sum() > 250 and all(said[i] == int(margin[i] <= 0) for i in np.flatnonzero(sure))


def test_rows_without_a_label_are_not_learned_from(spark):
    x, labels = noise(2, 40, 3)
    df = samples(spark, x, labels).selectExpr("sample_id", "_y as label", "features", "sample_id < 20 as test")
    unknown = df.selectExpr("sample_id + 100 as sample_id", "cast(null as int) as label", "features", "test").where("not test")
    alone, beside = (sorted((r.sample_id, r.predicted) for r in learn.classify(rows, "svm").collect()) for rows in (df, df.unionByName(unknown)))
    assert len(alone) == 20 and alone == beside
