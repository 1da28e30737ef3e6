"""Best-fit packing of documents into fixed-size training sequences, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAMES = ["doc_id", "piece", "piece_start", "piece_tokens", "shard", "bin", "bin_start"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
#: Equal rows are numbered in lists of so many.
_EQUALS = 1024


def pack(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int = 2) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given longest first.

    Open bins are ordered by residual, then age. For a piece the search starts at the first bin that
    has room, the tightest, and goes on to its successors until one neither holds the piece's
    duplicate cluster nor has its source ``per_source`` times; else a new bin opens. Each bin
    carries a bitmap of clusters and one bitmap of sources for each count up to ``per_source``.
    """
    order: list[tuple[int, int]] = []
    held: list[list[int]] = []
    out = []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        k = bisect_left(order, (n, -1))
        while k < len(order) and (held[order[k][1]][0] & c or held[order[k][1]][per_source] & s):
            k += 1
        if k < len(order):
            room, b = order.pop(k)
        else:
            room, b = capacity, len(held)
            held.append([0] * (per_source + 1))
        out.append((b, capacity - room))
        bits = held[b]
        bits[0] |= c
        level = next(i for i in range(1, per_source + 1) if not bits[i] & s)
        bits[level] |= s
        if room > n:
            insort(order, (room - n, b))
    return out


def pack_documents(docs: DataFrame, length, source, cluster, id_col: str = "doc_id", capacity: int = 2048, per_source: int = 2, shard_rows: int = 2048) -> DataFrame:
    """(doc_id, piece, piece_start, piece_tokens, shard, bin, bin_start) of every piece of every document.

    ``length``, ``source`` and ``cluster`` are columns or expressions. A document longer than
    ``capacity`` is cut there: its whole pieces each fill a bin and its rest is packed. Rows are dealt by
    a hash of their values, and of a number among their equals, into shards of about ``shard_rows`` rows, and each
    shard is packed by itself, longest piece first, ties by id; a hot source or cluster is thus spread
    over all shards, and so are equal rows. Bitmaps hold one bit for each source and cluster of the shard. A row of null or
    no length has one piece of 0 tokens; a null source is a source of its own, and rows of null
    cluster conflict with none. Repeated rows are packed as they are. An empty table gives no rows.
    """
    values = ["doc_id", "tokens", "source", "cluster"]
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("tokens"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    counted = small.groupBy(*values).agg(F.count("*").alias("n"))
    pages = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(_EQUALS))).alias("first"))
    rows = pages.select(*values, F.explode(F.sequence("first", F.least(F.col("first") + _EQUALS, "n") - 1)).alias("equal"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(*values, "equal"), F.lit(shards)).cast("int"))

    def run(key: tuple, shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([(c, "ascending") for c in ("doc_id", "cluster", "source", "tokens")]).combine_chunks()
        tokens = shard.column("tokens").to_numpy()
        sources = pc.fill_null(shard.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices, 0).to_numpy()
        coded = shard.column("cluster").combine_chunks().dictionary_encode()
        clusters = coded.indices.fill_null(0).to_numpy().astype(np.int64)
        none = coded.indices.is_null().to_numpy(zero_copy_only=False)
        clusters[none] = len(coded.dictionary) + np.flatnonzero(none)
        whole, rest = tokens // capacity, tokens % capacity
        left = np.argsort(-rest, kind="stable")
        left = left[(rest[left] > 0) | (whole[left] == 0)]
        placed = np.array(pack(rest[left].tolist(), sources[left].tolist(), clusters[left].tolist(), capacity, per_source), np.int64).reshape(-1, 2)
        full = np.repeat(np.arange(len(tokens)), whole)
        of = np.concatenate((left, full))
        piece = np.concatenate((whole[left], np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)))
        bins = np.concatenate((placed[:, 0], np.arange(len(full)) + placed[:, 0].max(initial=-1) + 1))
        columns = [shard.column("doc_id").take(pa.array(of)), piece, piece * capacity, np.concatenate((rest[left], np.full(len(full), capacity))), np.full(len(of), key[0].as_py()), bins, np.concatenate((placed[:, 1], np.zeros(len(full), np.int64)))]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, piece_start long, piece_tokens int, shard int, bin int, bin_start int")


def text_tokens(text_col: str = "text"):
    """Estimated tokens of a text: a quarter of its bytes, rounded up, and an end mark."""
    return F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / 4.0) + 1


def text_cluster(text_col: str = "text"):
    """Equal for texts that differ in letter case and white space only, at their ends too; null for a null text."""
    return F.md5(F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"\s+", " ")))
