"""The network: gradients, one task and several, rows that no line parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrest.operators import learn, network


def rings(n, seed):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1 + 2 * y + rng.normal(0, 0.2, n)
    return np.c_[radius * np.cos(angle), radius * np.sin(angle)], y


def samples(spark, x, y):
    return spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id long, _y int, features array<double>")


def test_gradients_are_those_of_finite_differences():
    rng, layers = np.random.default_rng(1), [3, 5, 4, 3]
    x, y, flat = rng.normal(size=(20, 3)), rng.integers(0, 3, 20), network.start(layers, 2)
    gradient = network.loss_and_gradient(flat, layers, x, y)[1]
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        by = (network.loss_and_gradient(flat + step, layers, x, y)[0] - network.loss_and_gradient(flat - step, layers, x, y)[0]) / 2e-6
        assert gradient[k] == pytest.approx(by, rel=1e-4, abs=1e-5)


def test_rows_without_a_batch_add_nothing():
    layers = [2, 3, 2]
    loss, gradient = network.loss_and_gradient(network.start(layers, 1), layers, np.zeros((0, 2)), np.zeros(0, int))
    assert loss == 0 and not gradient.any()


def test_tasks_that_share_the_work_take_the_same_steps(spark):
    x, y = rings(300, 3)
    df = samples(spark, x, y)
    alone, shared = (network.fit(df.repartition(k + 1), [2, 8, 4, 2], epochs=2, least_batch=150, tasks=k) for k in (1, 3))
    assert alone.epochs == shared.epochs == 2
    assert np.abs(alone.flat - shared.flat).max() < 1e-9


def test_rings_are_learned_and_a_bound_on_rows_holds(spark):
    x, y = rings(1500, 4)
    df = samples(spark, x, y)
    fitted = network.fit(df, [2, 100, 50, 2])
    far, labels = rings(400, 5)
    assert (fitted.scores(far).argmax(axis=1) == labels).mean() > 0.97 and fitted.epochs < 1000
    few = network.fit(df, [2, 100, 50, 2], most_rows=700)
    assert (few.scores(far).argmax(axis=1) == labels).mean() > 0.85  # half the rows and steps
    said = learn.classify(df.selectExpr("sample_id", "concat('l', _y) as label", "features", "sample_id % 5 = 0 as test"), "mlp")
    assert said.where(F.col("label") == F.col("predicted")).count() > 0.97 * 300
