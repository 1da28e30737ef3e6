"""Support vector machines with a Gaussian kernel and a hinge loss, one for each pair of labels, learned from all rows without bounds on their number."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.storage import stored

#: Rows of a kernel that a task holds at once, rows whose numbers one task moves, and rows on each side of a product in one task.
BLOCK, TASK, TILE = 2_048, 16_384, 32_768


def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * squared distance) of all rows of ``x`` and ``z``."""
    d = x @ z.T
    d *= -2
    d += (x * x).sum(axis=1)[:, None]
    d += (z * z).sum(axis=1)
    np.maximum(d, 0, out=d)
    d *= -gamma
    return np.exp(d, out=d)


def _sides(y: np.ndarray, alpha: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers can move up along the constraint, and which down."""
    return np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)


def solve_dual(k: np.ndarray, y: np.ndarray, c: float = 1.0, tol: float = 1e-3, alpha: np.ndarray | None = None, slope: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(alpha, bias) that maximise sum(alpha) - |sum(alpha y phi)|^2 / 2 with 0 <= alpha <= c and sum(alpha y) as it is, 0 without a start.

    Two numbers move at a time along the constraint: the one that breaks the optimality conditions most, and that which gains most with it. It ends when no two break them by more than ``tol``.
    ``alpha`` and ``slope`` are where to start, as when further rows have numbers that stay.
    """
    n = len(y)
    alpha = np.zeros(n) if alpha is None else alpha.copy()
    slope = y.astype(float) if slope is None else slope.copy()  # slope: y times the gain of raising alpha
    diagonal = np.einsum("ii->i", k)
    most = 1_000 * n + 10_000
    for _ in range(most):
        up, down = _sides(y, alpha, c)
        if not up.any() or not down.any():
            break
        i = int(np.where(up, slope, -np.inf).argmax())
        gap = slope[i] - slope
        if np.where(down, gap, -np.inf).max() <= tol:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.where(down & (gap > 0), gap * gap / curve, -np.inf).argmax())
        room_i, room_j = (c - alpha[i] if y[i] > 0 else alpha[i]), (alpha[j] if y[j] > 0 else c - alpha[j])
        move = min(gap[j] / curve[j], room_i, room_j)
        # a number that meets its bound is put on it, free of rounding
        alpha[i] = (c if y[i] > 0 else 0.0) if move == room_i else alpha[i] + y[i] * move
        alpha[j] = (0.0 if y[j] > 0 else c) if move == room_j else alpha[j] - y[j] * move
        slope -= move * (k[i] - k[j])
    else:
        raise ValueError(f"no machine of {n} rows after {most} steps")
    free = (alpha > 0) & (alpha < c)
    if free.any():
        return alpha, float(slope[free].mean())
    ends = [slope[s].max() if top else slope[s].min() for s, top in ((up, True), (down, False)) if s.any()]
    return alpha, float(np.mean(ends)) if ends else 0.0


def settle(x: np.ndarray, y: np.ndarray, gamma: float, alpha: np.ndarray, slope: np.ndarray, c: float = 1.0, tol: float = 1e-3, block: int = BLOCK) -> np.ndarray:
    """alpha of ``solve_dual`` for more rows than a kernel is held for.

    The ``block`` rows that break the conditions most, half of them on each side, are solved with the others held, and all slopes follow; so it goes on until no two rows break them by more than ``tol``.
    """
    alpha, slope = alpha.copy(), slope.copy()
    most = 1_000 + 100 * len(y)
    for _ in range(most):
        up, down = _sides(y, alpha, c)
        if not up.any() or not down.any() or slope[up].max() - slope[down].min() <= tol:
            return alpha
        if len(y) <= block + block // 4:
            return solve_dual(kernel(x, x, gamma), y, c, tol, alpha, slope)[0]
        ends = [np.argsort(np.where(side, way * slope, np.inf), kind="stable")[: min(max(1, block // 2), side.sum())] for side, way in ((up, -1), (down, 1))]
        own = np.union1d(*ends)
        moved = solve_dual(kernel(x[own], x[own], gamma), y[own], c, tol, alpha[own], slope[own])[0]
        change = (moved - alpha[own]) * y[own]
        alpha[own] = moved
        at = np.flatnonzero(change)
        z, change = x[own[at]], change[at]
        for rows in _slices(len(y), len(at)):
            slope[rows] -= kernel(x[rows], z, gamma) @ change
    raise ValueError(f"no machine of {len(y)} rows after {most} blocks")


def _slices(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows whose kernels with ``width`` others have about 2^18 numbers, so that they stay in a cache."""
    step = max(1, (1 << 18) // max(1, width))
    return (slice(lo, min(lo + step, n)) for lo in range(0, n, step))


class Machines(NamedTuple):
    """Support vectors of all pairs, each kept once, and (a, b, places, alpha * y, bias) of each pair."""

    vectors: np.ndarray
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, float]]
    gamma: float

    def parts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, weights, pairs) of each label: the vectors that are rows of it, and their weights in the pairs that it is in, a column each."""
        out = []
        for label in sorted({x for a, b, *_ in self.pairs for x in (a, b)}):
            mine = [(p, places[keep], weights[keep]) for p, (a, b, places, weights, _) in enumerate(self.pairs) if label in (a, b) for keep in [(weights > 0) == (label == a)]]
            out.append(_dense(mine))
        return out

    def of_label(self, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, weights, pairs) of all vectors of the pairs that ``label`` is in."""
        return _dense([(p, places, weights) for p, (a, b, places, weights, _) in enumerate(self.pairs) if label in (a, b)])

    def margins(self, x: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[slice, int, np.ndarray]]:
        """(rows, pair, margins) of the pairs in ``parts``, of all without: positive for the pair's first label; some rows at a time, so that kernels stay within 32 MB."""
        parts = self.parts() if parts is None else parts
        step = max(1, (1 << 22) // max(1, *(len(places) for places, _, _ in parts)) if parts else len(x))
        bias = np.array([b for *_, b in self.pairs])
        vectors = [self.vectors[places] for places, _, _ in parts]
        for lo in range(0, len(x), step):
            rows = slice(lo, min(lo + step, len(x)))
            out = np.tile(bias, (rows.stop - lo, 1))
            for own, (_, weights, pairs) in zip(vectors, parts, strict=True):
                out[:, pairs] += kernel(x[rows], own, self.gamma) @ weights
            for p in sorted({p for *_, pairs in parts for p in pairs.tolist()}):
                yield rows, p, out[:, p]

    def votes(self, x: np.ndarray, n_labels: int) -> np.ndarray:
        """The label number that wins most pairs, the smallest of equals."""
        won = np.zeros((len(x), n_labels), int)
        for rows, p, margin in self.margins(x):
            a, b = self.pairs[p][:2]
            won[rows, a] += margin > 0
            won[rows, b] += margin <= 0
        return won.argmax(axis=1)


def _dense(pairs: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, weights, pairs) of (pair, places, weights): each place once, with its weight in every pair."""
    places = np.unique(np.concatenate([own for _, own, _ in pairs])) if pairs else np.zeros(0, int)
    weights = np.zeros((len(places), len(pairs)))
    for k, (_, own, w) in enumerate(pairs):
        weights[np.searchsorted(places, own), k] = w
    return places, weights, np.array([p for p, *_ in pairs], int)


def _matrix(features: pd.Series) -> np.ndarray:
    return np.array(features.tolist(), float).reshape(len(features), -1)


class Learned(NamedTuple):
    """Machines of all pairs as a table: ``support`` (sample_id, _y, features, w) has each support vector once, ``w`` its alpha * y in the pair with each other label; and the bias of each pair."""

    support: DataFrame
    bias: dict[tuple[int, int], float]
    gamma: float
    n_labels: int


def _of_pairs(state: DataFrame, c: float) -> DataFrame:
    """(a, b, sample_id, other, y, alpha, slope, up, down): a row of ``state`` for each pair that its label is in."""
    each = state.select("sample_id", "_y", F.posexplode(F.arrays_zip("alpha", "slope")).alias("other", "s")).where("other <> _y")
    y = F.when(F.col("_y") < F.col("other"), 1.0).otherwise(-1.0)
    each = each.select(F.least("_y", "other").alias("a"), F.greatest("_y", "other").alias("b"), "sample_id", "other", y.alias("y"), "s.alpha", "s.slope")
    below, above = F.col("alpha") < c, F.col("alpha") > 0
    return each.withColumns({"up": F.when(F.col("y") > 0, below).otherwise(above), "down": F.when(F.col("y") > 0, above).otherwise(below)})


def _furthest(each: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each pair that break the conditions most, half of them on each side; ranked in 64 ranges first."""
    sides = F.array(F.when(F.col("up"), F.struct(F.lit(0).alias("side"), (-F.col("slope")).alias("key"))), F.when(F.col("down"), F.struct(F.lit(1).alias("side"), F.col("slope").alias("key"))))
    found = each.withColumn("_s", F.explode(sides)).where("_s is not null").withColumn("_part", F.pmod(F.xxhash64("sample_id"), F.lit(64)))
    for keys in (["a", "b", "_s.side", "_part"], ["a", "b", "_s.side"]):
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_s.key", "sample_id"))).where(F.col("_r") <= max(1, n // 2))
    return found.select(*each.columns).distinct()


def _products(rows: DataFrame, others: DataFrame, gamma: float, n_labels: int, labelled: bool, tile: int = TILE) -> DataFrame:
    """(sample_id, out): sums of w * kernel over ``others`` (sample_id, _y, features, w), for the pair with each other label of a row's own, or for all pairs if not ``labelled``.

    Rows and others are dealt into tiles by hash and each two tiles meet in one task, so neither side is whole anywhere.
    """
    table = [(a, b) for a in range(n_labels) for b in range(a + 1, n_labels)]
    place = np.zeros((n_labels, n_labels), int)
    for p, (a, b) in enumerate(table):
        place[a, b] = place[b, a] = p
    width = n_labels if labelled else len(table)
    kind = dict(rows.dtypes)["sample_id"]
    n, m = (max(-(-df.count() // tile), 4) for df in (rows, others))
    deal = [(F.pmod(F.xxhash64("sample_id"), F.lit(k)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) for k in (n, m)]
    left = rows.select("sample_id", (F.col("_y") if labelled else F.lit(-1)).alias("_y"), "features", deal[0][0].alias("_g"), deal[1][1].alias("_h"))
    right = others.select("_y", "features", "w", deal[0][1].alias("_g"), deal[1][0].alias("_h"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, out = _matrix(left["features"]), np.zeros((len(left), width))
        own = [(label, np.flatnonzero(left["_y"].to_numpy() == label)) for label in np.unique(left["_y"].to_numpy()).tolist()]
        for label, part in right.groupby("_y"):
            z, w = _matrix(part["features"]), _matrix(part["w"])
            apart = np.arange(n_labels) != label
            for mine, at in own:
                for rows in _slices(len(at), len(z)):
                    k = kernel(x[at[rows]], z, gamma)
                    if mine in (-1, label):
                        out[np.ix_(at[rows], place[label, apart] if mine < 0 else np.flatnonzero(apart))] += (k @ w)[:, apart]
                    else:
                        out[at[rows], label] += k @ w[:, mine]
        return pd.DataFrame({"sample_id": left["sample_id"], "out": list(out)}).astype({"sample_id": object})

    parts = left.groupBy("_g", "_h").cogroup(right.groupBy("_g", "_h")).applyInPandas(lambda a, b: run(a, b), f"sample_id {kind}, out array<double>")
    return parts.groupBy("sample_id").agg(F.array(*[F.sum(F.col("out")[k]) for k in range(width)]).alias("out"))


def learned(samples: DataFrame, n_labels: int, gamma: float, c: float = 1.0, block_rows: int = BLOCK, task_rows: int = TASK, tol: float = 1e-3) -> Learned:
    """Machines of all pairs of labels of ``samples`` (sample_id, _y from 0, features); ids differ. They are those of all rows: nothing is bounded but what a task holds.

    The rows of a pair are dealt by hash into blocks of about ``block_rows``, whatever the sizes of the labels, and each block is solved. The blocks' solutions together are a start: slopes of all rows follow from
    them, the ``task_rows`` rows of a pair that break its conditions most are solved with the others held, slopes follow the numbers that moved, and so on until no two rows of
    any pair break the conditions by more than ``tol``. Numbers and slopes are a table, a row a sample; one row a pair comes to the driver.
    """
    spark = samples.sparkSession
    kind = dict(samples.dtypes)["sample_id"]
    labels = F.sequence(F.lit(0), F.lit(n_labels - 1))
    samples = samples.select("sample_id", "_y", "features").where("_y is not null")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id", kind="stable")
        y, before = pdf["y"].to_numpy(float), pdf["alpha"].to_numpy(float)
        alpha = settle(_matrix(pdf["features"]), y, gamma, before, pdf["slope"].to_numpy(float), c, tol, block_rows)
        at = np.flatnonzero(alpha != before)
        # the number itself goes on too, as one on its bound has to stay there free of rounding; an empty column of strings has to be one of objects
        return pdf.iloc[at][["sample_id", "other"]].assign(alpha=alpha[at], w=((alpha - before) * y)[at]).astype({"sample_id": object})

    def moved(state: DataFrame, chosen: DataFrame) -> DataFrame:
        """``state`` after the numbers in ``chosen`` have been solved by pair and block."""
        found = chosen.join(samples.select("sample_id", "features"), "sample_id").groupBy("a", "b", "block").applyInPandas(lambda pdf: solve(pdf), f"sample_id {kind}, other int, alpha double, w double")
        found = found.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("other", F.struct("alpha", "w")))).alias("_m"))
        new = lambda name: F.transform(labels, lambda o: F.try_element_at("_m", o)[name])
        changes = stored(found.join(samples, "sample_id").select("sample_id", "_y", "features", F.transform(new("w"), lambda v: F.coalesce(v, F.lit(0.0))).alias("w"), new("alpha").alias("_alpha")), "changes")
        sums = _products(samples, changes, gamma, n_labels, True)
        next_state = state.join(sums, "sample_id").join(changes.select("sample_id", "_alpha"), "sample_id", "left")
        alpha = F.when(F.col("_alpha").isNull(), F.col("alpha")).otherwise(F.zip_with("_alpha", "alpha", lambda new, old: F.coalesce(new, old)))
        return stored(next_state.select("sample_id", "_y", alpha.alias("alpha"), F.zip_with("slope", "out", lambda s, v: s - v).alias("slope")), "numbers")

    counts = {r["_y"]: r["count"] for r in samples.groupBy("_y").count().collect()}  # one row a label
    blocks = [(a, b, max(1, -(-(counts.get(a, 0) + counts.get(b, 0)) // block_rows))) for a in range(n_labels) for b in range(a + 1, n_labels)]
    dealt = F.broadcast(spark.createDataFrame(blocks, "a int, b int, _blocks int"))
    state = samples.select("sample_id", "_y", F.transform(labels, lambda o: F.lit(0.0)).alias("alpha"), F.transform(labels, lambda o: F.when(F.col("_y") < o, 1.0).otherwise(-1.0)).alias("slope"))
    chosen = _of_pairs(state, c).join(dealt, ["a", "b"]).withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("_blocks")).cast("int"))
    while True:
        state = moved(state, chosen)
        each = _of_pairs(state, c)
        free = F.avg(F.when((F.col("alpha") > 0) & (F.col("alpha") < c), F.col("slope")))
        ends = each.groupBy("a", "b").agg(F.max(F.when(F.col("up"), F.col("slope"))).alias("top"), F.min(F.when(F.col("down"), F.col("slope"))).alias("end"), free.alias("free"), F.countDistinct("y").alias("sides")).collect()
        apart = [(r["a"], r["b"]) for r in ends if r["top"] is not None and r["end"] is not None and r["top"] - r["end"] > tol]
        if not apart:
            break
        chosen = _furthest(each.join(F.broadcast(spark.createDataFrame(apart, "a int, b int")), ["a", "b"]), task_rows).withColumn("block", F.lit(0))
    bias = {(r["a"], r["b"]): r["free"] if r["free"] is not None else float(np.mean([v for v in (r["top"], r["end"]) if v is not None])) for r in ends if r["sides"] == 2}
    w = F.transform("alpha", lambda v, o: F.when(F.col("_y") < o, v).otherwise(-v))
    support = state.where(F.exists("alpha", lambda v: v > 0)).select("sample_id", w.alias("w")).join(samples, "sample_id")
    return Learned(stored(support.select("sample_id", "_y", "features", "w"), "support"), bias, gamma, n_labels)


def predicted(samples: DataFrame, found: Learned) -> DataFrame:
    """``samples`` (sample_id, features and more) with ``_p``, the label number that wins most pairs, the smallest of equals."""
    pairs = [(p, *ab, found.bias[ab]) for p, ab in enumerate((a, b) for a in range(found.n_labels) for b in range(a + 1, found.n_labels)) if ab in found.bias]
    n_labels = found.n_labels

    @F.pandas_udf("int")
    def best(out: pd.Series) -> pd.Series:
        sums, won = _matrix(out), np.zeros((len(out), n_labels), int)
        for p, a, b, bias in pairs:
            ahead = sums[:, p] + bias > 0
            won[:, a] += ahead
            won[:, b] += ~ahead
        return pd.Series(won.argmax(axis=1), dtype="int32")

    sums = _products(samples.select("sample_id", "features"), found.support, found.gamma, n_labels, False)
    return samples.join(sums, "sample_id").withColumn("_p", best("out")).drop("out")


def fit(samples: DataFrame, n_labels: int, gamma: float, c: float = 1.0, block_rows: int = BLOCK, most_support: int | None = None, tol: float = 1e-3) -> Machines:
    """What ``learned`` gives as one object on the driver, for models that fit there; no query uses it.

    A caller who wants a smaller machine sets ``most_support``: if a pair has more support vectors, it gets the machines of half as many rows a label, those of the least hashes, instead.
    """
    found = learned(samples, n_labels, gamma, c, block_rows, max(TASK, block_rows), tol)
    rows = found.support.orderBy("sample_id").toPandas()
    y, w = rows["_y"].to_numpy(), _matrix(rows["w"])
    pairs = []
    for (a, b), bias in sorted(found.bias.items()):
        weights = np.where(y == a, w[:, b], np.where(y == b, w[:, a], 0.0))
        pairs.append((a, b, np.flatnonzero(weights), weights[weights != 0], bias))
    if most_support is not None and any(len(places) > most_support for _, _, places, *_ in pairs):
        least = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64("sample_id"), "sample_id"))
        return fit(samples.withColumn("_r", least).where(F.col("_r") <= max(1, most_support // 2)).drop("_r"), n_labels, gamma, c, block_rows, None, tol)
    return Machines(_matrix(rows["features"]), pairs, gamma)
