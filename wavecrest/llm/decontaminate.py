"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecrest.llm.common import Text, Words, ragged, scratch, text_slices, utf8, words

_TABLE_BITS = 16


def spaced(text: Text, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text as byte 0, a space, and its words each followed by a space; and where each word lies there."""
    lens = found.ends - found.starts
    n_docs = len(text.offsets) - 1
    per_doc = np.diff(found.first)
    doc = np.repeat(np.arange(n_docs), per_doc)
    ends = np.cumsum(lens + 1)
    at = ends - (lens + 1) + 2 * (doc + 1)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total + 2 * n_docs, 32, np.uint8)
    heads = 2 * np.arange(n_docs) + np.concatenate(([0], ends))[found.first[:-1]] if n_docs else np.zeros(0, np.int64)
    out[heads] = 0
    out[ragged(at, lens)] = text.data[ragged(found.starts, lens)]
    return out, at


class WuManber:
    """Searches many byte strings at once; strings of like length share one set of tables.

    The tables look at the first m bytes of each string, m being the shortest length: the last
    block of a window tells how far the window can move at least (shift table); where it can't
    move, the strings whose m bytes end in a block of that hash (bucket) are compared with the text.
    """

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.classes = []
        lens = np.array([len(p) for p in patterns], np.int64)
        for level in np.unique(np.frexp(lens)[1]) if len(lens) else []:
            own = np.flatnonzero(np.frexp(lens)[1] == level)
            m = int(lens[own].min())
            block = min(8, m)
            heads = np.frombuffer(b"".join(patterns[k][:m] for k in own) + bytes(8), np.uint8)
            shift = np.full(1 << _TABLE_BITS, m - block + 1, np.int64)
            first = np.arange(len(own)) * m
            for end in range(block, m + 1):
                h = self._hash(heads, first + end - block, block)
                np.minimum.at(shift, h, m - end)
            last = self._hash(heads, first + m - block, block)
            order = np.argsort(last, kind="stable")
            bucket = np.searchsorted(last[order], np.arange((1 << _TABLE_BITS) + 1))
            prefix = self._load(heads, first, block)
            self.classes.append((m, block, shift, bucket, own[order], prefix[order]))

    @staticmethod
    def _load(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
        """The ``block`` bytes at each position as a number; ``data`` has 8 spare bytes at its end."""
        words8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        return words8[at] & np.uint64((1 << 8 * block) - 1)

    @classmethod
    def _hash(cls, data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
        return ((cls._load(data, at, block) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern number) of every occurrence. The text is cut into lanes that move side by side."""
        starts, found = [], []
        n, whole = len(data), data.tobytes()
        data = np.concatenate((data, np.zeros(8, np.uint8)))
        for m, block, shift, bucket, own, prefix in self.classes:
            if n < m:
                continue
            pos = np.arange(m, n + 1, lane)  # ends of windows
            stop = np.minimum(pos + lane, n + 1)
            hits, keys = [], []
            while len(pos):
                h = self._hash(data, pos - block, block)
                step = shift[h]
                zero = step == 0
                if zero.any():
                    hits.append(pos[zero])
                    keys.append(h[zero])
                pos = pos + np.maximum(step, 1)
                live = pos < stop
                if not live.all():
                    pos, stop = pos[live], stop[live]
            if not hits:
                continue
            at, h = np.concatenate(hits) - m, np.concatenate(keys)
            n_own = bucket[h + 1] - bucket[h]
            slot, at = ragged(bucket[h], n_own), np.repeat(at, n_own)
            same = self._load(data, at, block) == prefix[slot]
            at, which = at[same], own[slot[same]]
            ok = np.fromiter((whole.startswith(self.patterns[p], a) for a, p in zip(at.tolist(), which.tolist(), strict=True)), bool, len(at))
            starts.append(at[ok])
            found.append(which[ok])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


def windows(rows: pa.Table, width: int) -> pa.Table:
    """Distinct windows (window, n_words, items) of the items (id, text); items are the sorted ids of those that have it.

    An item of fewer words than ``width``, but not none, is one window. A null id is named "null".
    """
    text = utf8(pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.string()))
    found = words(text)
    known: dict[bytes, tuple[int, set[str]]] = {}
    for k, item in enumerate(rows.column("id").to_pylist()):
        own = [text.data[a:b].tobytes() for a, b in zip(found.starts[found.first[k] : found.first[k + 1]], found.ends[found.first[k] : found.first[k + 1]], strict=True)]
        n = min(width, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            known.setdefault(b" " + b" ".join(own[a : a + n]) + b" ", (n, set()))[1].add("null" if item is None else str(item))
    return pa.table([pa.array(list(known), pa.binary()), pa.array([n for n, _ in known.values()], pa.int64()), pa.array([sorted(x) for _, x in known.values()], pa.list_(pa.string()))], names=["window", "n_words", "items"])


def write_windows(items: DataFrame, width: int, slice_bytes: int) -> list[str]:
    """Writes the windows of ``items`` (id, text) as files of about ``slice_bytes`` of text each, and gives their paths.

    Tasks write the files in shared storage, under temporary names until they are whole; only the paths come to the driver.
    """
    spark = items.sparkSession
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = scratch(spark, "windows")

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name = f"{key[0].as_py():06d}.arrow"
        temp = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
        own = windows(rows, width)
        with files.open_output_stream(temp) as out, pa.ipc.new_stream(out, own.schema) as stream:
            stream.write_table(own)
        files.move(temp, f"{path}/{name}")
        return pa.table({"file": [f"{folder}/{name}"]})

    sliced = items.distinct().withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-int(total) // slice_bytes)))))
    return sorted(r[0] for r in sliced.groupBy("slice").applyInArrow(write, "file string").collect())


class _Slice:
    """The windows of one file, ready for search."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_stream(path) as f:
            rows = pa.ipc.open_stream(f).read_all()
        self.machine = WuManber(rows.column("window").to_pylist())
        self.span = rows.column("n_words").to_numpy()
        self.items = rows.column("items")


class _Scan:
    """What the slices so far have found in a batch of texts."""

    def __init__(self, batch: pa.RecordBatch, column: int):
        self.batch, self.column = batch, column
        self.items: list[set] = [set() for _ in range(batch.num_rows)]
        self.hit: np.ndarray | None = None

    def add(self, of: _Slice | None) -> None:
        text = utf8(self.batch.column(self.column))
        found = words(text)
        n = len(found.starts)
        self.first = found.first
        self.hit = np.zeros(n, bool) if self.hit is None else self.hit
        if of is None:
            return
        data, at = spaced(text, found)
        starts, which = of.machine.search(data)
        change = np.zeros(n + 1, np.int64)
        w = np.searchsorted(at, starts + 1)
        np.add.at(change, w, 1)
        np.add.at(change, w + of.span[which], -1)
        self.hit |= np.cumsum(change)[:n] > 0
        doc = np.searchsorted(found.first, w, "right") - 1
        for d, p in np.unique(np.stack((doc, which), 1), axis=0).tolist():
            self.items[d].update(of.items[p].as_py())

    def rows(self, names: list[str]) -> pa.RecordBatch:
        n_hit = np.diff(np.concatenate(([0], np.cumsum(self.hit)))[self.first])
        own = [pa.array([sorted(x) for x in self.items], pa.list_(pa.string())), pa.array(np.diff(self.first), pa.int64()), pa.array(n_hit, pa.int64())]
        return pa.RecordBatch.from_arrays([*self.batch.columns, *own], names=[*names, "found_items", "n_words", "n_hit"])


def _scanner(slices: list[str], names: list[str], column: int, held_bytes: int):
    """A pass over the documents; of many slices one is in memory at a time, and goes over ``held_bytes`` of texts."""

    def scan(held: list[pa.RecordBatch], only: _Slice | None) -> Iterator[pa.RecordBatch]:
        found = [_Scan(batch, column) for batch in held]
        for uri in slices or [None]:
            own = only or (_Slice(uri) if uri else None)
            for x in found:
                x.add(own)
        for x in found:
            yield x.rows(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _Slice(slices[0]) if len(slices) == 1 else None
        held, size = [], 0
        for batch in text_slices(batches, names[column]):
            held.append(batch)
            size += batch.nbytes
            if len(slices) < 2 or size >= held_bytes:
                yield from scan(held, only)
                held, size = [], 0
        yield from scan(held, only)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "contamination", width: int = 10, item_id: str = "item_id", item_text: str = "text", slice_bytes: int = 4 << 20, held_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with a struct ``into`` (n_words, n_hit, n_items, items, items_sha256, contaminated).

    Words are maximal runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. A word
    inside an occurrence of any item's window of ``width`` words is hit. Windows of items are stored in slices of
    about ``slice_bytes`` of text, and one narrow pass over the documents takes one slice after another over each ``held_bytes`` of
    texts, so nothing of the documents is shuffled and no limit is set on the benchmark.
    Null and empty texts have no words; an empty benchmark hits nothing; repeated rows each get
    their result; a null item id is listed as "null"; a column of ``docs`` with the name ``into`` is replaced.
    """
    docs = docs.drop(into)
    slices = write_windows(benchmark.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")), width, slice_bytes)
    kept = docs.schema.fields
    names = [f"c{k}" for k in range(len(kept))]
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, kept, strict=True)], *T.StructType.fromDDL("found_items array<string>, n_words long, n_hit long").fields])
    out = docs.toDF(*names).mapInArrow(_scanner(slices, names, docs.columns.index(text_col), held_bytes), schema)
    result = F.struct(
        "n_words",
        "n_hit",
        F.size("found_items").cast("long").alias("n_items"),
        F.col("found_items").alias("items"),
        F.sha2(F.array_join("found_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept, strict=True)], result.alias(into))
