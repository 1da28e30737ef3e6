"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecrest.llm.common import LOWER, Text, stored, text_slices, utf8
from wavecrest.llm.perfect_hash import Index, build_index, shard_numbers

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def line_keys(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of lines, with those of text i from ``first[i]`` on; a text has one line more than it has line feeds."""
    feeds = np.flatnonzero(text.data == 10)
    n = np.diff(np.searchsorted(feeds, text.offsets)) + 1
    first = np.concatenate(([0], np.cumsum(n)))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    heads, tails = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    heads[first[:-1]] = tails[first[1:] - 1] = True
    starts[heads], starts[~heads] = text.offsets[:-1], feeds + 1
    ends[tails], ends[~tails] = text.offsets[1:], feeds
    return starts, ends, first


def line_hashes(text: Text, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length in bytes, 128-bit hash as two numbers) of each line's key: blanks at both ends off, A-Z in lower case."""
    dark = np.flatnonzero(~_BLANK[text.data])
    a, b = np.searchsorted(dark, starts), np.searchsorted(dark, ends)
    some = np.flatnonzero(b > a)
    size, h = np.zeros(len(starts), np.int64), np.zeros((len(starts), 2), np.uint64)
    if len(some):
        left, right = dark[a[some]], dark[b[some] - 1] + 1
        size[some] = right - left
        low = LOWER[text.data].tobytes()
        h[some] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(low[i:j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)]), ">u8").reshape(-1, 2)
    return size, h


def key_points(text: Text, starts: np.ndarray, ends: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Whether a line's key has ``least`` code points; only where its bytes don't tell are they counted."""
    enough = size >= 4 * least
    unsure = np.flatnonzero((size >= least) & ~enough)
    if least <= 1:
        enough[unsure] = True
        return enough
    for k in unsure.tolist():
        enough[k] = len(text.data[starts[k] : ends[k]].tobytes().decode("utf-8", "surrogatepass").strip(" \t\n\x0b\x0c\r")) >= least
    return enough


def line_index(docs: DataFrame, text_col: str = "text", least_documents: int = 10, least_points: int = 1) -> Index:
    """An index of the lines found in ``least_documents`` rows at least, by the first half of their hash; values are the second half and the count.

    Tasks count each row's different lines by hash; the counts of each hash are added up by a shuffle of 20 bytes a line. Rarer lines need no
    entry, as the second half, 64 bits, shows that they aren't there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 8 << 20):
            text = utf8(batch.column(0), lower=False)
            starts, ends, first = line_keys(text)
            size, h = line_hashes(text, starts, ends)
            use = np.flatnonzero(key_points(text, starts, ends, size, least_points))
            # different lines of each row, then how many rows of the batch have each
            rows = np.repeat(np.arange(batch.num_rows), np.diff(first))[use]
            order = np.lexsort((rows, h[use, 1], h[use, 0]))
            a, b, rows = h[use[order], 0], h[use[order], 1], rows[order]
            line = np.ones(len(order), bool)
            line[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            once = line.copy()
            once[1:] |= rows[1:] != rows[:-1]
            at = np.flatnonzero(line)
            n = np.add.reduceat(once, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "mark", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, mark long, n int").groupBy("h", "mark").agg(F.sum("n").alias("n"))
    return build_index(stored(counts.where(F.col("n") >= least_documents), "lines"), "line-index")


def probe(index: Index, h: np.ndarray) -> np.ndarray:
    """In how many documents each line is, 0 for lines that aren't in the index."""
    out = np.zeros(len(h), np.int64)
    if index.size and len(h):
        for k, at in index.parts(shard_numbers(h[:, 0], len(index.files))):
            if not index.files[k]:
                continue
            shard = index.shard(k)
            slot = shard.find(h[at, 0])
            there = np.flatnonzero(slot >= 0)
            there = there[shard.numbers("mark")[slot[there]].view(np.uint64) == h[at[there], 1]]
            out[at[there]] = shard.numbers("n")[slot[there]]
    return out


def without_lines(docs: DataFrame, index: Index, text_col: str = "text", into: str = "lines", least_documents: int = 10, least_points: int = 1) -> DataFrame:
    """``docs`` with a struct ``into`` (n_lines, n_dropped, most_documents, kept): ``kept`` is the text less the lines that ``index`` has in ``least_documents`` rows.

    A line's key has blanks (space and U+0009 to U+000D) taken off both ends and A-Z in lower case; keys of less than ``least_points`` code points stay. Lines that stay are as
    they were, joined by line feeds. Tasks hash the lines of some texts and look them up in one shard of the index after another, so no line is joined or shuffled, and
    a line that a third of all documents have costs what any other does. ``most_documents`` is the largest count of a line of the text that the index has, else 0.

    A null or empty text has one empty line, which stays; a text that loses all its lines is empty; repeated rows are documents of their own;
    an empty table gives no rows; a column of ``docs`` with the name ``into`` is replaced.
    """
    docs = docs.drop(into)
    kept = docs.schema.fields
    names = [f"c{k}" for k in range(len(kept))]
    column = docs.columns.index(text_col)
    own = T.StructType.fromDDL("n_lines long, n_dropped long, most_documents long, kept string")
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, kept, strict=True)], *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, names[column], 8 << 20):
            text = utf8(batch.column(column), lower=False)
            starts, ends, first = line_keys(text)
            size, h = line_hashes(text, starts, ends)
            counts = probe(index, h)
            counts[~key_points(text, starts, ends, size, least_points)] = 0
            drop = counts >= least_documents
            n_dropped = np.add.reduceat(drop, first[:-1], dtype=np.int64)
            whole, data, left = n_dropped == 0, text.data.tobytes(), []
            for k, (a, b) in enumerate(zip(text.offsets[:-1].tolist(), text.offsets[1:].tolist(), strict=True)):
                if whole[k]:
                    left.append(data[a:b])
                else:
                    stay = first[k] + np.flatnonzero(~drop[first[k] : first[k + 1]])
                    left.append(b"\n".join([data[i:j] for i, j in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
            columns = [pa.array(np.diff(first)), pa.array(n_dropped), pa.array(np.maximum.reduceat(counts, first[:-1])), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *own.names])

    out = docs.toDF(*names).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept, strict=True)], F.struct(*own.names).alias(into))


def drop_common_lines(docs: DataFrame, text_col: str = "text", into: str = "lines", least_documents: int = 10, least_points: int = 1) -> DataFrame:
    """``without_lines`` by the lines of ``docs`` itself."""
    return without_lines(docs, line_index(docs, text_col, least_documents, least_points), text_col, into, least_documents, least_points)
