"""Runs of repeated words: stretches that repeat with a period, found on harmonic grids."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecrest.llm.common import text_slices, utf8, words

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Places compared at once while a run is extended; doubled as it goes on.
_CHUNK = 64


def _matches(x: np.ndarray, p: int, at: int, end: int, step: int) -> int:
    """How many places from ``at`` on in direction ``step``, before ``end``, hold the same word p places further on."""
    found, chunk = 0, _CHUNK
    while True:
        n = min(chunk, (end - at) * step)
        if n <= 0:
            return found
        lo, hi = (at, at + n) if step > 0 else (at - n + 1, at + 1)
        differ = np.flatnonzero(x[lo:hi] != x[lo + p : hi + p])
        if len(differ):
            return found + int(differ[0] if step > 0 else n - 1 - differ[-1])
        found, at, chunk = found + n, at + n * step, min(2 * chunk, 1 << 16)


def word_runs(x: np.ndarray, ends: np.ndarray, least_words: int = 24, least_periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of texts that follow one another in ``x``, the longest first; text i ends before ``ends[i]``.

    ``x`` has word numbers and, at each text's end, a number that occurs nowhere else. A run of period p has at least ``least_periods`` periods (3 or more) and
    ``least_words`` words, so it holds a window of some neighbouring points of the grid 0, p, 2p, ... that all have the same word. For each period only such windows are looked at, over
    the texts that are long enough, and extended both ways as far as words repeat. A window inside a run of a smaller period q is passed over: it is longer than p + q, so a run of period p there
    would have the smaller period too. For the same reason a stretch whose smallest period is less than p is found as a run before.
    """
    if least_periods < 3:
        raise ValueError("runs have three periods or more")
    sizes = np.diff(ends, prepend=0)
    runs: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    covered: list[tuple[int, int]] = []
    longest, p = int(sizes.max(initial=0)), 1
    while p * least_periods < longest:
        need = max(least_words, least_periods * p)
        n_long = int(np.searchsorted(-sizes, -need, "left"))  # a text's size counts its end mark
        if not n_long:
            break
        limit = int(ends[n_long - 1])
        grid = x[0:limit:p]
        pairs = np.flatnonzero(grid[1:] == grid[:-1])
        points = need // p - 1  # neighbouring pairs in a window
        if len(pairs) >= points:
            cut = np.flatnonzero(np.diff(pairs) > 1)
            first, last = pairs[np.concatenate(([0], cut + 1))], pairs[np.concatenate((cut, [len(pairs) - 1]))]
            long = last - first + 1 >= points
            for j, final in zip(first[long].tolist(), last[long].tolist(), strict=True):
                while final - j + 1 >= points:
                    at = j * p
                    k = bisect_right(covered, (at, 1 << 62)) - 1
                    if k >= 0 and covered[k][1] > at + points * p:
                        j = max(j + 1, -(-covered[k][1] // p) - points)
                        continue
                    lo = at - _matches(x, p, at - 1, -1, -1)
                    differ = at + _matches(x, p, at, limit - p, 1)
                    hi = differ + p
                    if hi - lo >= need and (lo, hi) not in known:
                        runs.append((lo, hi - lo, p))
                        known.add((lo, hi))
                        insort(covered, (lo, hi))
                    j = differ // p + 1
        p += 1
    return runs


def _in_runs(runs: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """Whether each word is in a run after that run's first period."""
    change = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, text_col: str = "text", into: str = "runs", least_words: int = 24, least_periods: int = 3) -> DataFrame:
    """``docs`` with a struct ``into`` (n_words, runs, collapsed): the runs (start, length, period) by start, then period, and the words left, joined by a blank, when each run keeps its first period.

    Words are parted by blanks (space and U+0009 to U+000D) and numbered from 0. A run is a stretch with smallest period q, of at least ``least_words`` words and ``least_periods`` periods, that can't be longer.
    Narrow: texts are taken some megabytes at a time, a longer one by itself, whole. For n words, n / p points are compared for each period p, some n log n in all.
    A null or empty text has no words, no runs and an empty rest; repeated rows each get their result; an empty table gives no rows; a column
    of ``docs`` with the name ``into`` is replaced.
    """
    docs = docs.drop(into)
    kept = docs.schema.fields
    names = [f"c{k}" for k in range(len(kept))]
    column = docs.columns.index(text_col)
    own = T.StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, kept, strict=True)], *own.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, names[column], 4 << 20):
            text = utf8(batch.column(column), lower=False)
            found = words(text, _WORD)
            n = np.diff(found.first)
            data = text.data.tobytes()
            each = [data[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)]
            coded = pa.array(each, pa.binary()).dictionary_encode()
            number = coded.indices.to_numpy()
            order = np.argsort(-n, kind="stable")  # the longest text first
            ends = np.cumsum(n[order] + 1)
            begin = np.empty(len(n), np.int64)
            begin[order] = ends - n[order] - 1
            x = np.full(int(ends[-1]), -1, np.int32)
            x[np.repeat(begin - found.first[:-1], n) + np.arange(len(number))] = number
            x[ends - 1] = len(coded.dictionary) + np.arange(len(n))
            mine: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for start, length, period in word_runs(x, ends, least_words, least_periods):
                row = order[np.searchsorted(ends, start, "right")]
                mine[row].append((start - int(begin[row]), length, period))
            left = []
            for row, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
                mine[row].sort(key=lambda r: (r[0], r[2]))
                some = each[a:b]
                if mine[row]:
                    some = [some[k] for k in np.flatnonzero(~_in_runs(mine[row], b - a)).tolist()]
                left.append(b" ".join(some))
            shown = [[{"start": s, "length": k, "period": p} for s, k, p in r] for r in mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(shown, kind), pa.array(left, pa.binary()).cast(pa.string())], names=[*names, *own.names])

    out = docs.toDF(*names).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept, strict=True)], F.struct(*own.names).alias(into))


def best_run(runs):
    """The run of an array with the most periods, the first by start and period of equal ones; null if there is none. Shares are compared exactly, by cross products."""

    def better(best, r):
        more = r["length"] * best["period"] - best["length"] * r["period"]
        return F.when(best.isNull() | (more > 0), r).otherwise(best)  # runs come by start, then period

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
