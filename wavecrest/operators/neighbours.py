"""Exact nearest neighbours: train rows lie in cells around pivots, cells lie on shelves, and a query meets only the cells that can hold one of its neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.storage import stored


class Cells(NamedTuple):
    """Train rows with ``_cell``, queries with ``_cells``, those that they have to meet, and (cell, rows) of all cells that have any."""

    known: DataFrame
    asked: DataFrame
    sizes: list[tuple[int, int]]


#: Rows and values of features that a group holds of each side, the ways a side is dealt as long as that fits, and the least rows worth a group.
MOST_ROWS, MOST_VALUES, SIDES, LEAST_ROWS = 65_536, 1 << 22, 8, 1_024
#: Tasks that the groups are dealt to, at most.
MOST_TASKS = 2_048
#: Train rows a cell, on average, and cells a shelf, whose marks are bits of a long.
CELL_ROWS, SHELF_CELLS = 8_192, 62


def _matrix(features: pd.Series) -> np.ndarray:
    return np.array(features.tolist(), float).reshape(len(features), -1)


def _squares(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ z.T + (z * z).sum(axis=1), 0)


def pivots(train: DataFrame, n: int, sample_rows: int = 16_384, steps: int = 4) -> np.ndarray:
    """At most ``n`` different centres of a sample, the ``sample_rows`` rows of least hash; where they lie changes the work, not the result."""
    rows = train.select("features", F.xxhash64("sample_id").alias("_h")).orderBy("_h").limit(min(sample_rows, 16 * n)).toPandas()
    x = _matrix(rows["features"])
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:n]]
    for _ in range(steps):
        own = _squares(x, centres).argmin(axis=1)
        used = np.unique(own)
        centres = np.array([x[own == c].mean(axis=0) for c in used])
    return np.unique(centres, axis=0)


def celled(train: DataFrame, queries: DataFrame, k: int, n_cells: int, apart: str | None = None) -> Cells:
    """Deals train rows to their nearest pivots and finds the cells each query has to meet.

    A cell's k rows nearest to its pivot bound a query's k-th distance from above, by way of the pivot; the k-th least bound over all cells holds. From below, a cell is no nearer than the
    pivot's distance less the cell's radius, than its least radius less that distance, and than the plane between its pivot and the query's. Cells beyond the bound are left out. Both bounds have
    some slack for rounding. Train rows are stored with their cells, queries with theirs; k numbers and two radii a cell come to the driver and are broadcast. With ``apart`` a query's bounds are
    those of the train rows that differ from it in that column, an int of a few values, so there are k numbers for each cell and value.
    """
    spark = train.sparkSession
    centres = spark.sparkContext.broadcast(pivots(train, n_cells))

    @F.pandas_udf("cell int, d double")
    def own(xs: pd.Series) -> pd.DataFrame:
        if not len(xs):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "d": pd.Series(dtype=float)})
        x = _matrix(xs)
        cell = _squares(x, centres.value).argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "d": np.sqrt(((x - centres.value[cell]) ** 2).sum(axis=1))})

    known = stored(train.withColumn("_o", own("features")).select(*train.columns, F.col("_o.cell").alias("_cell"), F.col("_o.d").alias("_d")), "cells")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple[int, float, np.ndarray]] = {}
        for batch in batches:
            for key, d in batch.groupby(["_cell", "_apart"])["_d"]:
                n, far, near = held.get(key, (0, 0.0, np.zeros(0)))
                held[key] = n + len(d), max(far, d.max()), np.sort(np.r_[near, d.to_numpy()])[:k]
        yield pd.DataFrame([(*c, *v) for c, v in held.items()], columns=["cell", "apart", "n", "far", "near"])

    # without ``apart`` every train row differs from every query
    parts = known.select("_cell", "_d", (F.col(apart) if apart else F.lit(0)).cast("int").alias("_apart")).mapInPandas(partial, "cell int, apart int, n long, far double, near array<double>")
    rows = parts.groupBy("cell", "apart").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")).collect()  # one row a cell, or a cell and value
    cells = np.unique([r.cell for r in rows])
    totals, far, pools = np.zeros(len(cells), np.int64), np.zeros(len(cells)), [{} for _ in cells]
    for r in rows:
        i = int(np.searchsorted(cells, r.cell))
        totals[i], far[i], pools[i][r.apart] = totals[i] + r.n, max(far[i], r.far), r.near

    def bounds(own: int | None) -> np.ndarray:
        near = np.full((len(cells), k), np.inf)
        for i, pool in enumerate(pools):
            found = sorted(d for value, some in pool.items() if value != own for d in some)[:k]
            near[i, : len(found)] = found
        return near

    others = {own: bounds(own) for own in {None, *(r.apart for r in rows if apart)}}
    shape = spark.sparkContext.broadcast((cells, others, far))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, others, far = shape.value
        z = centres.value[cells]
        between = np.sqrt(_squares(z, z))
        for batch in batches:
            x, out = _matrix(batch["features"]), [None] * len(batch)
            for own, places in batch.groupby("_apart").indices.items():
                near = others.get(own, others[None])
                for at in np.split(places, range(256, len(places), 256)):
                    square = _squares(x[at], z)
                    d = np.sqrt(square)
                    slack = 1e-6 * (1 + d.max(axis=1, keepdims=True) + np.abs(x[at]).max(axis=1, keepdims=True))
                    ways = np.sort((d[:, :, None] + near).reshape(len(d), -1), axis=1)
                    bound = ways[:, k - 1, None] + slack
                    first = square.argmin(axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.nan_to_num((square - square[np.arange(len(d)), first][:, None]) / (2 * between[first]), nan=0.0, posinf=0.0, neginf=0.0)
                    least = np.maximum(np.maximum(d - far, near[:, 0] - d), plane)
                    for i, row in zip(at, least <= bound, strict=True):
                        out[i] = cells[row].tolist()
            yield batch.assign(_cells=out)

    kind = dict(queries.dtypes)
    asked = queries.select("sample_id", "features", (F.col(apart) if apart else F.lit(-1)).cast("int").alias("_apart"))
    asked = stored(asked.mapInPandas(met, f"sample_id {kind['sample_id']}, features array<double>, _apart int, _cells array<int>"), "visits")
    return Cells(known, asked, [(int(c), int(n)) for c, n in zip(cells, totals, strict=True)])


def shelves(sizes: list[tuple[int, int]], rows: int) -> list[tuple[int, int, int, int]]:
    """(cell, shelf, bit, parts): cells put together, in their order, to shelves of at most ``rows`` rows; a larger cell is alone and has several parts."""
    out, shelf, bit, held = [], -1, 0, 0
    for cell, n in sizes:
        if shelf < 0 or held + n > rows or bit + 1 == SHELF_CELLS:
            shelf, bit, held = shelf + 1, -1, 0
        bit, held = bit + 1, held + n
        out.append((cell, shelf, bit, max(1, -(-n // rows))))
    return out


def nearest(train: DataFrame, queries: DataFrame, k: int = 5, block_rows: int | None = None, most_cells: int = 1_024, apart: str | None = None) -> DataFrame:
    """(sample_id, predicted): the commonest label of the k nearest train rows, ties by smallest label.

    With ``apart``, the name of an int column of both sides with few values, a query's neighbours are among the train rows of other values, so all folds are one job.

    Train rows are dealt into cells of some ``CELL_ROWS``, at most ``most_cells``, and cells are put on shelves; a query goes once to each shelf with a cell that it has to meet, and is held against those
    of its cells. A shelf's rows, and its visitors, are at most ``block_rows``, or else are dealt by hash into parts and blocks, and each part and block of a shelf meet in one group, which keeps k candidates
    a query. By default ``block_rows`` is an eighth of the train rows within bounds of memory, so a row moves at most some eight times on each side up to half a million rows; beyond, groups stay
    bounded and rows move more often. Of few train rows there is one cell.
    """
    n, width = train.agg(F.count("*"), F.max(F.size("features"))).first()
    most = block_rows or max(1, min(MOST_ROWS, MOST_VALUES // max(1, width or 1), max(LEAST_ROWS, -(-n // SIDES))))
    n_cells = min(most_cells, max(1, -(-n // min(CELL_ROWS, 2 * block_rows if block_rows else CELL_ROWS))))

    def place(n):
        return F.pmod(F.xxhash64("sample_id"), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def value(other: int):
        return (F.col(apart) if apart else F.lit(other)).cast("int").alias("_apart")

    if n_cells > 1:
        spark = train.sparkSession
        known, asked, sizes = celled(train, queries, k, n_cells, apart)
        placed = shelves(sizes, most)
        where, n_shelves = {cell: (shelf, bit) for cell, shelf, bit, _ in placed}, placed[-1][1] + 1

        @F.pandas_udf("array<long>")
        def marked(cells: pd.Series) -> pd.Series:
            out = np.zeros((len(cells), n_shelves), np.int64)
            for row, met in zip(out, cells, strict=True):
                for shelf, bit in map(where.__getitem__, met):
                    row[shelf] |= 1 << bit
            return pd.Series(list(out))

        asked = asked.select("sample_id", "features", "_apart", F.posexplode(marked("_cells")).alias("_shelf", "_marks")).where("_marks <> 0")
        visits = dict(asked.groupBy("_shelf").count().collect())  # one row a shelf
        table = spark.createDataFrame([(*p, max(1, -(-visits.get(p[1], 0) // most))) for p in placed], "_cell int, _shelf int, _bit int, _parts int, _blocks int")
        groups = sum(parts * blocks for parts, blocks in {p[1]: (p[3], max(1, -(-visits.get(p[1], 0) // most))) for p in placed}.values())
        known = known.join(F.broadcast(table), "_cell").withColumn("_apart", value(0))
        asked = asked.join(F.broadcast(table.groupBy("_shelf").agg(F.first("_parts").alias("_parts"), F.first("_blocks").alias("_blocks"))), "_shelf")
    else:
        parts, blocks = max(1, -(-n // most)), max(1, -(-queries.count() // most))
        groups, one = parts * blocks, {"_shelf": F.lit(0), "_parts": F.lit(parts), "_blocks": F.lit(blocks)}
        known, asked = train.withColumns(one | {"_bit": F.lit(0), "_apart": value(0)}), queries.withColumns(one | {"_marks": F.lit(1).cast("long"), "_apart": value(-1)})
    keys = ["_shelf", "_part", "_block"]
    asked = asked.select("sample_id", "features", "_apart", "_marks", "_shelf", place(F.col("_blocks")).alias("_block"), every(F.col("_parts")).alias("_part"))
    # own names, as both sides may come from one table
    known = known.select(F.col("sample_id").alias("near"), F.col("label").alias("label"), F.col("features").alias("x"), F.col("_apart").alias("_other"), "_bit", "_shelf", every(F.col("_blocks")).alias("_block"), place(F.col("_parts")).alias("_part"))

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"sample_id": [], "d": [], "near": [], "label": []}, dtype=object)
        # rows of a cell and value lie side by side, and so do queries that meet the same cells
        t, q = t.sort_values(["_other", "_bit"], kind="stable"), q.sort_values(["_apart", "_marks"], kind="stable")
        x, y, ids, labels, asked = _matrix(t["x"]), _matrix(q["features"]), t["near"].to_numpy(), t["label"].to_numpy(), q["sample_id"].to_numpy()
        own, bit, values, marks, sizes = t["_other"].to_numpy(), t["_bit"].to_numpy(), q["_apart"].to_numpy(), q["_marks"].to_numpy(), (x * x).sum(axis=1)
        step = max(16, min(512, (1 << 22) // len(t)))
        whose, places, distances = [], [], []
        for value in np.unique(values):
            mine = np.flatnonzero(values == value)
            for lo in range(0, len(mine), step):
                some_q = mine[lo : lo + step]
                met = (own != value) & ((np.bitwise_or.reduce(marks[some_q]) >> bit) & 1 == 1)
                if not met.any():
                    continue
                edges = np.flatnonzero(np.diff(np.r_[False, met, False].astype(np.int8)))
                spans = list(zip(edges[::2], edges[1::2], strict=True))
                at = np.flatnonzero(met)
                double = -2 * y[some_q]
                rough = np.concatenate([double @ x[a:b].T for a, b in spans], axis=1)
                rough += sizes[at]  # squares of distances, less the query's own
                n = min(k, len(at))
                worst = np.partition(rough, n - 1, axis=1)[:, n - 1]
                for i, row, w in zip(some_q, rough, worst, strict=True):
                    # the product's rounding moves near ties, so all within it of the k-th are measured again
                    some = at[np.flatnonzero(row <= w + 1e-9 * (abs(w) + float(y[i] @ y[i]) + 1))]
                    d = ((x[some] - y[i]) ** 2).sum(axis=1)
                    first = np.lexsort((ids[some], d))[:k]
                    whose.append(np.full(len(first), i))
                    places.append(some[first])
                    distances.append(d[first])
        if not whose:
            return pd.DataFrame({"sample_id": [], "d": [], "near": [], "label": []}, dtype=object)
        at = np.concatenate(places)
        return pd.DataFrame({"sample_id": asked[np.concatenate(whose)], "d": np.concatenate(distances), "near": ids[at], "label": labels[at]}, dtype=object)

    kind = dict(train.dtypes)
    spread = min(4 * groups, MOST_TASKS)  # few groups share a task
    asked, known = asked.repartition(spread, *keys), known.repartition(spread, *keys)
    found = asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(run, f"sample_id {kind['sample_id']}, d double, near {kind['sample_id']}, label {kind['label']}")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("sample_id").orderBy("d", "near"))).where(F.col("_r") <= k)
    votes = first.groupBy("sample_id", "label").count()
    return votes.groupBy("sample_id").agg(F.min(F.struct((-F.col("count")).alias("n"), "label"))["label"].alias("predicted"))
