"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.llm.common import mix, range_hashes, release, stored, text_slices, tidy, utf8, words

#: Keys of the n-gram of no word, counted once for each word, and of the start mark, counted once for each text.
_NONE, _START = np.uint64(1), np.uint64(2)
#: A place is a block's number and, in the low bits, the number of an n-gram in it; a block's number is its task's and, in the low bits, its own.
_SLOT_BITS, _SEQ_BITS = 28, 15


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers as zstd of all their first bytes, then all second ones and so on."""
    return zstandard.ZstdCompressor(3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, ids, n_words, vocabulary, text): the texts of about ``block_bytes`` bytes as numbers of words.

    ``vocabulary`` has the hash of each different word of the block, the most frequent first, and ``text`` the numbers
    of all its words in order.
    """

    def block(number: int, held: list) -> pa.RecordBatch:
        hashes, numbers, counts = np.unique(np.concatenate([h for _, _, h in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        ids = pa.concat_arrays([i for i, _, _ in held])
        n_words = np.concatenate([n for _, n, _ in held])
        columns = [pa.array([number]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([n_words.astype("<i4").tobytes()]), pa.array([hashes[order].tobytes()]), pa.array([_pack(place[numbers])])]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "n_words", "vocabulary", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << _SEQ_BITS
        for batch in text_slices(batches, "text"):
            text = utf8(batch.column(1))
            found = words(text)
            held.append((batch.column(0), np.diff(found.first), range_hashes(text.data, found.starts, found.ends)))
            size += len(text.data) + 64 * batch.num_rows
            if size >= block_bytes:
                yield block(number, held)
                held, size, number = [], 0, number + 1
        if held:
            yield block(number, held)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(tidy(run), "block long, ids array<long>, n_words binary, vocabulary binary, text binary")


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, which of them each is, and how often each occurs."""
    order = np.argsort(values)
    values = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    which = np.empty(len(values), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    first = np.flatnonzero(new)
    return values[first], which, np.diff(np.append(first, len(values))).astype(np.int32)


class Grams:
    """The different n-grams of a block, of 0 to ``order`` words, dealt into buckets by hash; ``slots[m][p]`` is the n-gram of m words that ends at position p, a text's start mark being a position too."""

    def __init__(self, n_words: bytes, vocabulary: bytes, text: bytes, order: int, buckets: int):
        self.n_words = np.frombuffer(n_words, "<i4").astype(np.int64)
        per_text = self.n_words + 1
        self.heads = np.cumsum(per_text) - per_text
        size = int(per_text.sum())
        known = np.concatenate(([_START], np.frombuffer(vocabulary, "<u8")))
        numbers = np.zeros(size, np.int32)
        word = np.ones(size, bool)
        word[self.heads] = False
        numbers[word] = _unpack(text)
        numbers[word] += 1
        self.depth = np.arange(size, dtype=np.int32) - np.repeat(self.heads, per_text).astype(np.int32)
        hashes, counts = [np.array([_NONE]), known], [np.array([word.sum()], np.int32), np.bincount(numbers, minlength=len(known)).astype(np.int32)]
        del word
        slots, base, last = [np.zeros(size, np.int8), numbers + np.int32(1)], 1 + len(known), known[numbers]
        for m in range(2, order + 1):
            last = mix(mix(np.roll(last, 1)) + known[numbers])
            there = self.depth >= m - 1
            own, which, n = _distinct(last[there])
            hashes.append(own)
            counts.append(n)
            slots.append(np.full(size, -1, np.int32))
            slots[m][there] = which + np.int32(base)
            base += len(own)
        del last, numbers
        h, n = np.concatenate(hashes), np.concatenate(counts)
        bucket = ((h >> np.uint64(32)).astype(np.int64) * buckets >> 32).astype(np.int32)
        by = np.lexsort((n, bucket))
        place = np.empty(len(h) + 1, np.int32)
        place[by], place[-1] = np.arange(len(h)), -1
        self.slots = [place[x] for x in slots]
        self.hashes, self.counts = h[by], n[by]
        self.used, self.first = np.unique(bucket[by], return_index=True)


def gram_rows(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, start, hashes, counts): each block's different n-grams by bucket; ``start`` is the place of the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *parts in zip(*(batch.column(k) for k in range(4)), strict=True):
                grams = Grams(*(x.as_py() for x in parts), order, buckets)
                offsets = pa.array(np.concatenate((grams.first, [len(grams.hashes)])).astype(np.int32))
                columns = [pa.array(grams.used.astype(np.int32)), pa.array((number.as_py() << _SLOT_BITS) + grams.first), pa.ListArray.from_arrays(offsets, pa.array(grams.hashes.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(grams.counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "start", "hashes", "counts"])
                del grams, columns
                release()

    return blocks.select("block", "n_words", "vocabulary", "text").mapInArrow(tidy(run), "bucket int, start long, hashes array<long>, counts array<int>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, total) in order of place, as one row for each run of neighbours."""
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(place) != 1) + 1))
        starts = place[cuts]
        offsets = pa.array(np.concatenate((cuts, [len(place)])).astype(np.int32))
        columns = [pa.array(starts >> _SLOT_BITS), pa.array((starts & ((1 << _SLOT_BITS) - 1)).astype(np.int32)), pa.ListArray.from_arrays(offsets, batch.column(1))]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "slot", "totals"])


def _own_counts(slots: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """How often the n-gram at each position occurs in the position's text."""
    _, which, n = _distinct(text * np.int64(size + 1) + slots + 1)
    return n[which]


def block_scores(grams: Grams, totals: np.ndarray, least: int, alpha: float, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the scores of each text's words, how many of them were scored by less words than there are before them)."""
    text = np.repeat(np.arange(len(grams.heads)), grams.n_words + 1) if leave_out else None

    def counts(m: int) -> np.ndarray:
        if not leave_out:
            return totals[grams.slots[m]]
        if m:
            return totals[grams.slots[m]] - _own_counts(grams.slots[m], text, len(totals))
        return np.repeat(totals[grams.slots[0][:1]] - grams.n_words, grams.n_words + 1)

    shorter = counts(1)
    value = np.log(np.maximum(shorter, 1)) - np.log(np.maximum(counts(0), 1))
    backed = np.zeros(len(value), bool)
    for m in range(2, len(grams.slots)):
        there = grams.depth >= m - 1
        own = counts(m)
        value[there] += math.log(alpha)
        seen = np.flatnonzero(there & (own >= least))
        value[seen] = np.log(own[seen]) - np.log(shorter[seen - 1])
        backed[there], backed[seen] = True, False
        shorter = own
    value[grams.heads], backed[grams.heads] = 0, False
    if not len(value):
        return np.zeros(0), np.zeros(0, np.int64)
    return np.add.reduceat(value, grams.heads), np.add.reduceat(backed, grams.heads, dtype=np.int64)


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, least: int = 1, alpha: float = 0.4, block_bytes: int = 8 << 20, leave_out: bool = False) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_backed_off) of every row, under the n-gram counts of all rows, or of all other rows if ``leave_out``.

    A word scores ln(count(n-gram) / count(its first n - 1 words)) for the longest n-gram of at most ``order`` words that
    ends in it and occurs ``least`` times, and ln(alpha) for each longer one passed over; the last resort is its share of all
    words. A text's first word follows a start mark that every text has. Words are those of decontamination, and each
    counts as itself, however rare.

    Texts are stored in numbered blocks first. Each block sends each of its different n-grams once, with its count in the
    block, to a bucket by hash; there all rows of an n-gram meet in the count table and each takes the total, and totals go back to their
    block, which sums them up by text. The commonest n-gram is one row a block. A block that misses a total is an error.
    With ``leave_out`` a text is scored by what the others say: its own n-grams, counted where it is scored, are taken off each total, so that
    an n-gram that no other text has is unseen and backs off; a word that no other text has counts once. ``n_backed_off`` words are not
    scored by the longest n-gram that ends in them.

    A text without words scores 0 and has a null mean; repeated rows count and score again; an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * n
    blocks = stored(text_blocks(docs, id_col, text_col, block_bytes), "blocks")
    dealt = gram_rows(blocks, order, buckets).repartition(n, "bucket")
    rows = dealt.select("bucket", "start", "counts", F.posexplode("hashes").alias("k", "h")).select("bucket", (F.col("start") + F.col("k")).alias("place"), "h", F.get("counts", "k").alias("n"))
    counted = rows.select("place", F.sum("n").over(Window.partitionBy("h", "bucket")).alias("total"))
    totals = counted.sortWithinPartitions("place").mapInArrow(tidy(_runs), "block long, slot int, totals array<long>")

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        ids, *parts = (block.column(c)[0] for c in ("ids", "n_words", "vocabulary", "text"))
        grams = Grams(*(x.as_py() for x in parts), order, buckets)
        total = np.full(len(grams.hashes), -1)
        for slot, own in zip(found.column("slot").to_pylist(), found.column("totals"), strict=True):
            total[slot : slot + len(own)] = own.values.to_numpy()
        if total.min() < 0:
            raise ValueError("a block's n-grams were not all counted")
        del found
        grams.hashes = grams.counts = None
        sums, backed = block_scores(grams, total, least, alpha, leave_out)
        n_words = grams.n_words
        del grams, total
        release()
        return pa.table([ids.values, pa.array(n_words), pa.array(sums), pa.array(sums / np.maximum(n_words, 1), mask=n_words == 0), pa.array(backed)], names=["doc_id", "n_words", "log_score", "mean_log_score", "n_backed_off"])

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long")
