"""Collocations: phrases of a language that occur more often than their parts suggest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.llm.common import Words, discard, mix, scratch, stored, text_slices, tidy, utf8, words
from wavecrest.llm.perfect_hash import ARRAYS, MANIFEST, SHARD_KEYS, Counter, Index, Shard, build_index, index_rows, pack, read_manifest, shard_numbers, tree_sum, unpack, write_shard

#: Bytes that end a piece of text; blanks part words.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
#: A sieve has at most 2 to this power of counters, for some 1.7e10 occurrences; a task sends its counts when it has so many.
_SIEVE_BITS, _SIEVE_HELD = 30, 1 << 21
#: Keys of a shard whose values are texts and lists.
_SMALL = 1 << 15


def _squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers as zstd of all their first bytes, then all second ones and so on."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _spread(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _word_array(data: np.ndarray, found: Words) -> pa.Array:
    """The words as one Arrow array of binary."""
    sizes = found.ends - found.starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(len(data) + 1, np.int8)
    mark[found.starts] += 1
    np.subtract.at(mark, found.ends, 1)
    own = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])


def _ipc(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def _vocabulary(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def text_blocks(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int, held_bytes: int) -> DataFrame:
    """(lang, n_words, vocabulary, text): texts of a language as numbers of words, the commonest first, from 1; 0 ends a piece. ``vocabulary`` is an Arrow stream of the words and their counts."""

    def block(lang: str, held: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        own = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        numbers, vocabulary = own.indices.to_numpy(), own.dictionary
        counts = np.bincount(numbers, minlength=len(vocabulary))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        new = np.concatenate([first for _, first in held])  # whether a piece begins with the word
        at = np.arange(len(numbers)) + np.cumsum(new)
        text = np.zeros(len(numbers) + int(new.sum()), np.int64)
        text[at] = place[numbers]
        own = pa.table([vocabulary.take(pa.array(order)).cast(pa.large_string()).cast(pa.string()), pa.array(counts[order])], names=["word", "n"])
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(numbers)]), pa.array([_ipc(own)], pa.binary()), pa.array([_squeeze(text)])], names=["lang", "n_words", "vocabulary", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, int]] = {}
        for batch in text_slices(batches, "text", 1 << 20):
            langs = batch.column(1).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                text = utf8(batch.column(0).filter(pc.equal(langs.indices, k)))
                found = words(text, _WORD)
                if not len(found.starts):
                    continue
                ends = np.concatenate(([0], np.cumsum(_ENDS[text.data])))
                first = np.ones(len(found.starts), bool)
                first[1:] = ends[found.starts[1:]] > ends[found.ends[:-1]]
                first[found.first[:-1][np.diff(found.first) > 0]] = True
                parts, size = held.get(lang, ([], 0))
                parts.append((_word_array(text.data, found), first))
                held[lang] = (parts, size + len(text.data))
                if held[lang][1] >= block_bytes:
                    yield block(lang, held.pop(lang)[0])
            if sum(n for _, n in held.values()) >= held_bytes:
                lang = max(held, key=lambda x: held[x][1])
                yield block(lang, held.pop(lang)[0])
        for lang, (parts, _) in held.items():
            yield block(lang, parts)

    chosen = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return chosen.mapInArrow(tidy(run), "lang string, n_words long, vocabulary binary, text binary")


def block_words(blocks: DataFrame) -> DataFrame:
    """(lang, word, n) of each block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _vocabulary(data)
                yield from own.add_column(0, "lang", pa.array([lang] * len(own), pa.string())).to_batches(1 << 14)

    return blocks.select("lang", "vocabulary").mapInArrow(tidy(run), "lang string, word string, n long")


def _word_key(word, lang):
    """A word and its language as one text; words have no blanks."""
    return F.concat(word, F.lit(" "), lang)


def numbered(blocks: DataFrame, index: Index) -> DataFrame:
    """(words, slots): each block as numbers of ``index``'s words from 1, with 0 for one or more of a piece's end and words that aren't there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, vocabulary, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                keys = pc.binary_join_element_wise(_vocabulary(vocabulary.as_py()).column("word").chunk(0), lang, " ")
                h = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in keys.to_pylist()), np.uint64, len(keys))
                number = index.find(h)
                there = np.flatnonzero(number >= 0)
                if not len(there):
                    continue
                same = pc.equal(keys.take(pa.array(there)), index.read(number[there], ["key"]).column("key").chunk(0)).to_numpy(zero_copy_only=False)
                known = np.zeros(len(keys) + 1, np.int64)
                known[there[same] + 1] = number[there[same]] + 1
                own = known[_spread(text.as_py())]
                own = own[(own > 0) | np.concatenate(([False], own[:-1] > 0))]
                data = pa.array([_squeeze(own)])
                yield pa.RecordBatch.from_arrays([data, data], names=["words", "slots"])

    return blocks.select("lang", "vocabulary", "text").mapInArrow(tidy(run), "words binary, slots binary")


def _extended(words_: bytes, slots: bytes, m: int) -> tuple[np.ndarray, ...]:
    """(positions, key, prefix, suffix, last) of places where m words follow whose first and last m - 1 are frequent, numbers from 0.

    A phrase's key is made of the number of its first m - 1 words and that of its last word, one to one.
    """
    own, at = _spread(words_), _spread(slots)
    here = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
    prefix, suffix, last = at[here] - 1, at[here + 1] - 1, own[here + m - 1] - 1
    return here, mix(prefix.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)), prefix, suffix, last


class Sieve(NamedTuple):
    """Which values of a key's leading ``bits`` occur often enough, as files of bits for ranges of them."""

    bits: int
    range_bits: int
    files: dict[int, str]
    passing: int

    def passes(self, key: np.ndarray) -> np.ndarray:
        """The positions of keys that may be frequent."""
        place = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        marks = _marks(self)
        return np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)


_HELD: list[tuple[Sieve, np.ndarray]] = []


def _marks(sieve: Sieve) -> np.ndarray:
    """The bits of a sieve, read once by a worker: at most 128 MB, and as a rule an eighth of a byte for 16 occurrences."""
    if not _HELD or _HELD[0][0] != sieve:
        out = np.zeros((1 << sieve.bits - sieve.range_bits, 1 << sieve.range_bits - 3), np.uint8)
        for k, uri in sieve.files.items():
            files, path = fs.FileSystem.from_uri(uri)
            with files.open_input_stream(path) as f:
                out[k] = np.frombuffer(f.read(), np.uint8)
        _HELD[:] = [(sieve, out.ravel())]
    return _HELD[0][1]


def sieve(state: DataFrame, m: int, occurrences: int, least: int) -> Sieve:
    """Occurrences are counted by their keys' leading bits, with a counter for some 16 of them, so that a key with a rare value can't be frequent.

    Counters stop at ``least``. A task sends ranges of them, mostly zeros and packed, in proportion to its different keys; the
    sums' bits are written as a file a range.
    """
    bits = min(_SIEVE_BITS, max(12, math.ceil(math.log2(occurrences / 16 + 1))))
    range_bits = min(20, max(6, bits - 6))
    folder = scratch(state.sparkSession, "sieve")

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, n = np.unique(np.concatenate(held), return_counts=True)
        n = np.minimum(n, least)
        cuts = np.flatnonzero(np.diff(at >> range_bits, prepend=-1))
        for own, count in zip(np.split(at, cuts[1:]), np.split(n, cuts[1:]), strict=True):
            counts = np.zeros(1 << range_bits, np.int64)
            counts[own & (1 << range_bits) - 1] = count
            yield pa.RecordBatch.from_arrays([pa.array([int(own[0]) >> range_bits]), pa.array([part], pa.int32()), pa.array([pack(counts)], pa.binary())], names=["shard", "part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = _extended(w, s, m)[1]
                held.append((key >> np.uint64(64 - bits)).astype(np.int32))
                size += len(key)
                if size >= _SIEVE_HELD:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                marks = np.packbits(unpack(data) >= least, bitorder="little")
                if marks.any():
                    files.create_dir(path, recursive=True)
                    name = f"{k:06d}-{TaskContext.get().taskAttemptId()}"
                    with files.open_output_stream(f"{path}/{name}") as out:
                        out.write(marks.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([f"{folder}/{name}"]), pa.array([int(np.bitwise_count(marks).sum())])], names=["shard", "file", "n"])

    found = tree_sum(state.mapInArrow(tidy(count), ARRAYS), most=least, finish=mark, schema=MANIFEST).collect()  # at most 1,024 names
    return Sieve(bits, range_bits, {r.shard: r.file for r in found}, sum(r.n for r in found))


_COLUMNS = ("prefix", "suffix", "last")


def _once(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(h, prefix, suffix, last) of different h."""
    key, *parts = (np.concatenate(x) for x in zip(*held, strict=True))
    h, first = np.unique(key, return_index=True)
    return (h, *(x[first] for x in parts))


def candidates(state: DataFrame, m: int, sifted: Sieve) -> Index:
    """An index of the different phrases of m words that may be frequent: their parts are, and the sieve lets them through.

    A task sends arrays of its different keys, one for each shard; a key is sent once as long as a task's keys are no more than half of ``_SIEVE_HELD``. There is a shard for
    so many counters of the sieve, so that a task that puts a shard's arrays together has a bounded number of keys.
    """
    folder = scratch(state.sparkSession, "candidate-index")
    shards = max(1, -(-2 * sifted.passing // SHARD_KEYS))

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, *parts = _once(held)
        cuts = np.searchsorted(shard_numbers(h, shards), np.arange(shards + 1))  # h is in order
        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if j > i:
                data = pack(np.concatenate((np.diff(h[i:j], prepend=np.uint64(0)), *(x[i:j].astype(np.uint64) for x in parts))))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([data], pa.binary())], names=["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, key, *parts = _extended(w, s, m)
                some = sifted.passes(key)
                held.append(_once([(key[some], *(x[some] for x in parts))]))
                size += len(held[-1][0])
                if size > _SIEVE_HELD:
                    held = [_once(held)]
                    size = len(held[0][0])
                    if size > _SIEVE_HELD // 2:
                        yield from send(held)
                        held, size = [], 0
        if size:
            yield from send(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def shard() -> pa.RecordBatch:
            h, *parts = _once(held)
            rows = pa.table([pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in parts)], names=["h", *_COLUMNS])
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([write_shard(folder, at, rows)]), pa.array([len(h)])], names=["shard", "file", "n"])

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != at:
                    if held:
                        yield shard()
                    at, held = k, []
                h, *parts = unpack(data).reshape(4, -1)
                held.append((np.cumsum(h), *parts))
                if sum(len(x[0]) for x in held) > 4 * SHARD_KEYS and len(held) > 1:
                    held = [_once(held)]
        if held:
            yield shard()

    sent = state.mapInArrow(tidy(run), "shard long, data binary").repartition("shard").sortWithinPartitions("shard")
    return read_manifest(sent.mapInArrow(tidy(write), MANIFEST), shards)


def counted(state: DataFrame, m: int, index: Index, least: int) -> DataFrame:
    """(h, prefix, suffix, last, a) of the candidates in ``index`` that occur ``least`` times: tasks look each place's key up and count slots in arrays, and the arrays are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lambda k: index.firsts[k + 1] - index.firsts[k])
        firsts = np.array(index.firsts)
        for batch in batches:
            for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number = index.find(_extended(w, s, m)[1])
                number = number[number >= 0]
                for k, at in index.parts(np.searchsorted(firsts, number, "right") - 1):
                    counter.add(k, number[at] - firsts[k])
                yield from counter.rows()
        yield from counter.rows(last=True)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a = unpack(data).astype(np.int64)
                own = index.shard(k).rows.append_column("a", pa.array(a)).filter(pa.array(a >= least))
                yield from own.replace_schema_metadata(None).to_batches()

    return tree_sum(state.mapInArrow(tidy(count), ARRAYS), finish=frequent, schema="h long, prefix int, suffix int, last int, a long")


def with_cuts(found: DataFrame, word_index: Index, shorter: Index) -> DataFrame:
    """``found`` with its text and language, and the counts of its first 1, 2, ... and last ..., 2, 1 words, read by number from the arrays of the phrases one word shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, suffix, last = (batch.column(k).to_numpy() for k in (1, 2, 3))
            head, tail, end = shorter.read(prefix, ["phrase", "lang", "a", "lefts"]), shorter.read(suffix, ["a", "rights"]), word_index.read(last, ["phrase"])
            text = pc.binary_join_element_wise(head.column("phrase").chunk(0), end.column("phrase").chunk(0), " ")
            lefts = [[*x, a] for x, a in zip(head.column("lefts").to_pylist(), head.column("a").to_pylist(), strict=True)]
            rights = [[a, *x] for x, a in zip(tail.column("rights").to_pylist(), tail.column("a").to_pylist(), strict=True)]
            columns = [*batch.columns, text, head.column("lang").chunk(0), pa.array(lefts, pa.list_(pa.int64())), pa.array(rights, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "phrase", "lang", "lefts", "rights"])

    return found.mapInArrow(tidy(run), "h long, prefix int, suffix int, last int, a long, phrase string, lang string, lefts array<long>, rights array<long>")


def advanced(state: DataFrame, m: int, index: Index) -> DataFrame:
    """``state`` with the numbers of the frequent phrases of m words in place of those of m - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here, key, *_ = _extended(w, s, m)
                slots = np.zeros(len(_spread(w)), np.int64)
                slots[here] = index.find(key) + 1
                # only the words of a frequent phrase go on; after one's first word comes its second, so no new neighbours are made
                first = np.flatnonzero(slots)
                if len(first):
                    change = np.bincount(first, minlength=len(slots) + 1) - np.bincount(first + m, minlength=len(slots) + 1)[: len(slots) + 1]
                    stay = np.cumsum(change[:-1]) > 0
                    yield pa.RecordBatch.from_arrays([pa.array([_squeeze(_spread(w)[stay])], pa.binary()), pa.array([_squeeze(slots[stay])], pa.binary())], names=["words", "slots"])

    return state.mapInArrow(tidy(run), "words binary, slots binary")


_PHRASE = "level int, number long, prefix long, suffix long, phrase string, lang string, a long, lefts array<long>, rights array<long>"


def _phrases(level: int):
    def form(first: int, shard: Shard) -> pa.Table:
        rows = shard.rows
        n = len(rows)
        columns = [pa.array(np.full(n, level, np.int32)), pa.array(first + np.arange(n)), rows["prefix"].cast(pa.int64()), rows["suffix"].cast(pa.int64()), rows["phrase"], rows["lang"], rows["a"], rows["lefts"], rows["rights"]]
        return pa.table(columns, names=["level", "number", "prefix", "suffix", "phrase", "lang", "a", "lefts", "rights"])

    return form


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, block_bytes: int = 4 << 20, held_bytes: int = 12 << 20) -> tuple[DataFrame, DataFrame]:
    """((level, number, prefix, suffix, phrase, lang, a, lefts, rights), (lang, n)): every phrase of 2 to ``longest`` words that occurs ``least`` times in its language, and the words of each language.

    ``prefix`` and ``suffix`` are the numbers, one level down, of all words but the last and but the first; ``lefts`` and ``rights`` count the first 1, 2, ... and the last ..., 2, 1 words.

    Words that occur ``least`` times are counted by a shuffle of each block's vocabulary. Then, level by level, an occurrence
    counts only if its first and its last words are frequent; a hashed sieve of counts drops most of those that can't be frequent, the different keys left
    get a sharded minimal perfect hash, and tasks count slots in arrays that are added up as a tree. A key is exact (the number of
    the first words and of the last word), and a look-up compares it. Texts are stored as numbers of words, so that they are read as text once;
    a task has one block and some shards in memory, whatever the size of the corpus, and a common phrase or language is spread over all tasks.
    """
    spark = docs.sparkSession
    blocks = stored(text_blocks(docs, text_col, lang_col, block_bytes, held_bytes), "phrase-blocks")
    totals = stored(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    vocabulary = block_words(blocks).groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    none = F.array().cast("array<bigint>")
    word_rows = stored(vocabulary.select(F.xxhash64(_word_key("word", "lang")).alias("h"), _word_key("word", "lang").alias("key"), F.col("word").alias("phrase"), "lang", "a", none.alias("lefts"), none.alias("rights")), "words")
    occurrences = word_rows.agg(F.sum("a")).first()[0]
    levels: list[DataFrame] = []
    if occurrences:
        word_index = build_index(word_rows, "word-index", _SMALL)
        state = stored(numbered(blocks, word_index), "numbered")
        discard(blocks, word_rows)
        shorter = word_index
        for m in range(2, longest + 1):
            sifted = sieve(state, m, occurrences, least)
            if not sifted.files:
                break
            index = candidates(state, m, sifted)
            found = stored(counted(state, m, index, least), "counted")
            occurrences = found.agg(F.sum("a")).first()[0]
            if not occurrences:
                break
            frequent = stored(with_cuts(found, word_index, shorter), "frequent")
            shorter = build_index(frequent, "phrase-index", _SMALL)
            discard(found, frequent)
            levels.append(index_rows(spark, shorter, _phrases(m), _PHRASE))
            if m < longest:
                state, before = stored(advanced(state, m, shorter), "numbered"), state
                discard(before)
    out = spark.createDataFrame([], _PHRASE)
    for level in levels:
        out = out.unionByName(level)
    return out, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, share: int = 100, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` frequent phrases by score, then count, both falling, then phrase by bytes.

    Cut after its first k words, a phrase that occurs a times scores floor(1000 a n / (l r)), with l and r the counts of both parts and n that of all words of the
    language; the lowest cut counts, the first of equal ones. A phrase of which a longer frequent one has ``share`` percent of the occurrences is left out;
    as counts fall with every word more, phrases one word longer decide that.

    A-Z are lower-cased; ``.,;:!?`` and line breaks end pieces, blanks and tabs part words, and phrases lie within pieces. A null text is empty, a null language
    is ``und``; repeated rows count again; an empty table, and a corpus without a frequent phrase, give no rows. Products are decimals of 38 digits.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, longest, least)
    found = stored(found, "phrases")
    longer = found.select((F.col("level") - 1).alias("level"), F.explode(F.array("prefix", "suffix")).alias("number"), "a").groupBy("level", "number").agg(F.max("a").alias("_longer"))
    kept = found.join(longer, ["level", "number"], "left").where(F.col("_longer").isNull() | (F.lit(100).cast("long") * F.col("_longer") < F.lit(share).cast("long") * F.col("a")))

    def wide(x):
        return x.cast("decimal(38,0)")

    sized = kept.join(totals, "lang").withColumn("_top", wide(F.lit(1000)) * wide(F.col("a")) * wide(F.col("n")))
    sized = sized.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("lefts") - 1)))
    cut = sized.select("lang", "phrase", "a", "n", "_top", "_k", F.get("lefts", "_k").alias("l"), F.get("rights", "_k").alias("r"))
    scored = cut.withColumn("score", F.expr("_top div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "_k", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = lowest.select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r").withColumn("rank", F.row_number().over(order))
    return flat.where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
