"""Nearest neighbours by cells against all distances."""

import numpy as np
import pytest

from wavecrest.operators import learn
from wavecrest.operators import neighbours as N


def table(spark, x, first=0, labels=3):
    return spark.createDataFrame([(first + i, f"l{(first + i) * 7 % labels}", [float(f) for f in row]) for i, row in enumerate(x)], "sample_id long, label string, features array<double>")


def plain(train, queries, k):
    known, out = train.collect(), {}
    for q in queries.collect():
        near = sorted((sum((a - b) ** 2 for a, b in zip(q.features, r.features, strict=True)), r.sample_id, r.label) for r in known)[:k]
        labels = [r[2] for r in near]
        out[q.sample_id] = min(set(labels), key=lambda x: (-labels.count(x), x))
    return out


def clustered(n, seed, dims=6, centres=20):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).uniform(-10, 10, (centres, dims))
    return middle[rng.integers(0, centres, n)] + rng.normal(0, 0.3, (n, dims))


def noise(n, seed):
    return np.random.default_rng(seed).normal(size=(n, 16))


def grid(n, seed):
    """Few places, so most distances are tied and rows repeat."""
    return np.random.default_rng(seed).integers(0, 3, (n, 2)).astype(float)


@pytest.mark.parametrize("form", [clustered, noise, grid])
def test_cells_leave_out_no_neighbour(spark, form):
    train, queries = table(spark, form(500, 1)), table(spark, form(90, 2), 1_000)
    got = {r.sample_id: r.predicted for r in N.nearest(train, queries, 5, block_rows=12).collect()}
    assert got == plain(train, queries, 5)


def test_hot_cell_and_fewer_rows_than_neighbours(spark):
    x = np.r_[np.zeros((200, 2)), np.random.default_rng(3).normal(5, 1, (30, 2))]
    train, queries = table(spark, x), table(spark, x[::9] + 0.01, 1_000)
    assert {r.sample_id: r.predicted for r in N.nearest(train, queries, 7, block_rows=8).collect()} == plain(train, queries, 7)
    few = table(spark, x[-3:])
    assert {r.sample_id: r.predicted for r in N.nearest(few, queries, 5, block_rows=1).collect()} == plain(few, queries, 5)
    nothing = train.where("false")
    assert N.nearest(nothing, queries).count() == 0 and N.nearest(train, queries.where("false"), 5, block_rows=8).count() == 0


def test_share_of_cells_that_queries_meet(spark):
    share = {}
    for form in (clustered, noise):
        cells = N.celled(table(spark, form(2_000, 1)), table(spark, form(200, 2), 5_000), 5, 20)
        share[form.__name__] = cells.asked.selectExpr("avg(size(_cells))").first()[0] / len(cells.sizes)
    assert share["clustered"] < 0.2 < share["noise"] <= 1


@pytest.mark.parametrize("form", [clustered, noise, grid])
@pytest.mark.parametrize("block_rows", [12, 60, None])
def test_neighbours_of_other_folds_in_one_job(spark, form, block_rows):
    rows = table(spark, form(240, 4)).selectExpr("*", "CAST(sample_id % 7 % 3 AS INT) AS fold")
    got = {r.sample_id: r.predicted for r in N.nearest(rows, rows, 5, block_rows=block_rows, apart="fold").collect()}
    want = {}
    for fold in range(3):
        want |= plain(rows.where(f"fold <> {fold}"), rows.where(f"fold = {fold}"), 5)
    assert got == want


def test_few_rows_of_other_folds(spark):
    """One fold holds all rows but two, so its rows have two neighbours, and a fold alone has none."""
    rows = table(spark, clustered(60, 5)).selectExpr("*", "CAST(sample_id < 2 AS INT) AS fold")
    want = plain(rows.where("fold = 1"), rows.where("fold = 0"), 5) | plain(rows.where("fold = 0"), rows.where("fold = 1"), 5)
    assert {r.sample_id: r.predicted for r in N.nearest(rows, rows, 5, block_rows=4, apart="fold").collect()} == want
    assert N.nearest(rows.where("fold = 0"), rows.where("fold = 0"), 5, block_rows=4, apart="fold").count() == 0


def test_shelves_are_bounded():
    got = N.shelves([(0, 30), (2, 50), (3, 40), (5, 250), (6, 10)], 100)
    assert got == [(0, 0, 0, 1), (2, 0, 1, 1), (3, 1, 0, 1), (5, 2, 0, 3), (6, 3, 0, 1)]
    assert max(bit for _, _, bit, _ in N.shelves([(c, 1) for c in range(200)], 10_000)) < 63


def shuffled(spark, run):
    """Records that the shuffles of ``run`` write."""
    context = spark.sparkContext
    context.setJobGroup(group := f"moved-{id(run)}", "")
    run()
    context.setJobGroup("other", "")
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_moved_rows_grow_no_faster_than_the_input(spark, monkeypatch):
    """On noise of many dimensions every query meets every cell; four times the rows are four times the cells, and yet a row moves as often."""
    monkeypatch.setattr(N, "CELL_ROWS", 100)
    monkeypatch.setattr(N, "LEAST_ROWS", 50)
    each = {}
    for n in (1_000, 4_000):
        rows = table(spark, np.random.default_rng(6).normal(size=(n, 40))).localCheckpoint()
        each[n] = shuffled(spark, lambda rows=rows: learn.cross_validate(rows, "knn").collect()) / n
    assert 0 < each[4_000] < 1.6 * each[1_000]
