"""A network with rectified hidden nodes, learned by Adam on mini-batches that tasks share."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of features that a task holds before a further task is used.
TASK_VALUES = 1 << 23


class Network(NamedTuple):
    """``layers`` are the sizes from features to labels; ``flat`` has each layer's weights (inputs by outputs) and biases, one after another."""

    layers: list[int]
    flat: np.ndarray
    epochs: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _forward(_parts(self.flat, self.layers), x)[-1]


def _parts(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of ``flat``."""
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:], strict=True):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(layers: list[int], seed: int) -> np.ndarray:
    """Even random numbers within the root of 6 over a layer's inputs and outputs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)) for a, b in zip(layers[:-1], layers[1:], strict=True)])


def _forward(parts: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """Values of all layers; the last are sums, not shares."""
    values = [x]
    for k, (w, b) in enumerate(parts):
        z = values[-1] @ w + b
        values.append(np.maximum(z, 0) if k < len(parts) - 1 else z)
    return values


def loss_and_gradient(flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross-entropy of labels ``y``, summed over rows, and its gradient; sums over parts of the rows add up."""
    parts = _parts(flat, layers)
    values = _forward(parts, x)
    z = values[-1] - values[-1].max(axis=1, keepdims=True)
    share = np.exp(z)
    share /= share.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = -float(np.log(np.maximum(share[rows, y], 1e-300)).sum())
    delta = share
    delta[rows, y] -= 1
    out = np.zeros_like(flat)
    for k, (dw, db) in reversed(list(enumerate(_parts(out, layers)))):
        dw[:] = values[k].T @ delta
        db[:] = delta.sum(axis=0)
        if k:
            delta = (delta @ parts[k][0].T) * (values[k] > 0)
    return loss, out


def _spread(h: np.ndarray, epoch: int) -> np.ndarray:
    """Hashes dealt anew for each epoch."""
    h = (h ^ np.uint64(epoch * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, h: np.ndarray, layers: list[int], steps: int, add: Callable[[np.ndarray], np.ndarray], seed: int, epochs: int, patience: int, patience_steps: int = 200, rate: float = 1e-3, decay: float = 1e-4) -> tuple[np.ndarray, int]:
    """(weights, epochs): one task's part of the learning. ``add`` gives the sum of all tasks' arrays, so every task takes the same steps.

    An epoch has ``steps`` mini-batches; a row's place in them follows from its hash ``h`` and the epoch, not from its task. Learning ends when the share of ``held`` rows that are right, or at the same share their loss (without
    any, the loss of the others), hasn't become better by 1e-4 in ``patience`` epochs and ``patience_steps`` steps (few rows have one step an epoch), and the best weights count.
    """
    own, kept = np.flatnonzero(~held), np.flatnonzero(held)
    weight = np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in zip(layers[:-1], layers[1:], strict=True)])  # biases don't decay
    flat = start(layers, seed)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    best, top, least, stale, n = flat, -np.inf, np.inf, 0, 0
    for epoch in range(1, epochs + 1):
        batch = (_spread(h[own], epoch) % np.uint64(steps)).astype(np.int64)
        loss, count = 0.0, 0
        for k in range(steps):
            rows = own[batch == k]
            part = loss_and_gradient(flat, layers, x[rows], y[rows])
            total = add(np.r_[part[1], part[0], len(rows)])
            if not total[-1]:
                continue
            loss, count, n = loss + total[-2], count + total[-1], n + 1
            gradient = (total[:-2] + decay * weight * flat) / total[-1]
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            flat = flat - rate * np.sqrt(1 - 0.999**n) / (1 - 0.9**n) * first / (np.sqrt(second) + 1e-8)
        right = (_forward(_parts(flat, layers), x[kept])[-1].argmax(axis=1) == y[kept]).sum() if len(kept) else 0
        right, asked, lost = add(np.array([right, len(kept), loss_and_gradient(flat, layers, x[kept], y[kept])[0]], float))
        score, lost = (right / asked, lost / asked) if asked else (0.0, loss / max(count, 1))
        if score > top + 1e-4 or (score >= top and lost < least - 1e-4):
            best, top, least, stale = flat, score, lost, 0
        else:
            stale += 1
        if stale >= patience and stale * steps >= patience_steps:
            break
    return best, epoch


def fit(samples: DataFrame, layers: list[int], seed: int = 42, epochs: int = 1000, patience: int = 10, least_batch: int = 200, most_rows: int = 1 << 20, tasks: int | None = None) -> Network:
    """A network learned from (sample_id, _y, features); a tenth of the rows, by a hash of their id, only says when to stop.

    Up to ``TASK_VALUES`` values of features are one task's work. More are dealt to the tasks of a barrier stage, at most as many as run at once, which add up their gradients in each step,
    so the result is that of one task but for rounding. As a step waits for all tasks, an epoch has at most 20 mini-batches, of ``least_batch`` rows at least. Of more than ``most_rows`` rows those of the least hashes
    are learned from. A lost executor restarts the stage, which takes the same steps again. The driver gets the weights only.
    """
    spark = samples.sparkSession
    marked = samples.select("_y", "features", F.xxhash64("sample_id", F.lit(seed)).alias("h"))
    n = marked.count()
    if n > most_rows:
        marked = marked.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))
        n = most_rows
    slots = spark.sparkContext.defaultParallelism
    tasks = min(tasks or -(-n * layers[0] // TASK_VALUES), slots) or 1
    steps = max(1, -(-n // max(least_batch, -(-n // 20))))
    marked = marked.repartition(tasks, "h") if tasks > 1 else marked.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        x = np.concatenate([np.zeros((0, layers[0])), *[_rows(b.column(1)) for b in parts]])
        y = np.concatenate([np.zeros(0, np.int64), *[b.column(0).to_numpy() for b in parts]]).astype(np.int64)
        signed = np.concatenate([np.zeros(0, np.int64), *[b.column(2).to_numpy() for b in parts]])
        order = np.lexsort((*x.T[:1], y, signed))  # the same sums, however the rows came
        x, y, signed = x[order], y[order], signed[order]
        context = BarrierTaskContext.get() if tasks > 1 else None

        def add(values: np.ndarray) -> np.ndarray:
            if context is None:
                return values
            return np.sum([np.frombuffer(base64.b64decode(m)) for m in context.allGather(base64.b64encode(values.tobytes()).decode())], axis=0)

        flat, took = train(x, y, signed % 10 == 0, signed.astype(np.uint64), layers, steps, add, seed, epochs, patience)
        if context is None or context.partitionId() == 0:
            yield pa.RecordBatch.from_pylist([{"flat": flat.tolist(), "epochs": took}], pa.schema([("flat", pa.list_(pa.float64())), ("epochs", pa.int32())]))

    found = marked.mapInArrow(run, "flat array<double>, epochs int", barrier=tasks > 1).collect()[0]
    return Network(layers, np.array(found["flat"]), found["epochs"])


def _rows(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(features), -1)


def predicted(samples: DataFrame, network: Network) -> DataFrame:
    """``samples`` with ``_p``, the number of the label with the highest score."""
    model = samples.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("int")
    def best(xs: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(np.array(xs.tolist(), float)).argmax(axis=1) if len(xs) else [], dtype="int32")

    return samples.withColumn("_p", best("features"))
