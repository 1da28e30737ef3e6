"""Token ids of documents in binary files, Huffman coded, in ascending order of document id."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from wavecrest.llm.common import LOWER, Text, ragged, range_hashes, scratch, stored, text_slices, tidy, utf8
from wavecrest.llm.huffman import BLOCK, Decoder, canonical_codes, code_lengths, encode

MAGIC = b"TOKHUF01"
#: What a vocabulary's file must do to texts for them to be cut into pieces here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Kinds of bytes: ASCII white space 0, letters 1, digits 2, other ASCII 3, all others 4.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 4


def _plain_letters(data: np.ndarray) -> np.ndarray:
    """Marks bytes of a-z and of the letters from U+00C0 to U+00FF."""
    lead = data == 0xC3
    # U+00D7 and U+00F7 between them are signs, which join ASCII marks in a word
    lead[:-1] &= (data[1:] != 0x97) & (data[1:] != 0xB7)
    after = np.concatenate(([False], lead[:-1]))
    return (_KIND[data] == 1) | lead | after


class WordTokenizer:
    """The tokenizers library's ids of whole texts, with each different word encoded once.

    Texts are cut at ASCII white space and where letters, digits and other ASCII characters meet, but for a letter after an
    apostrophe, if the vocabulary's file drops white space, lowers case and cuts there too, so that a text's ids are its pieces' ids;
    texts of any other vocabulary are encoded whole. Pieces of letters go to the library's own model and byte mapping
    without the rest of its pipeline, which leaves them as they are; all others through the whole
    pipeline. Texts with characters from U+0300 on, which may combine with their neighbours, or with
    the opening of a special token, are encoded whole. Known pieces are kept by their 64-bit hash; up to eight bytes a hash
    stands for one piece of each length, and longer pieces are compared with the one that taught the ids. A text with a piece
    of another length or other bytes is encoded whole.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.cuts = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and not spec["model"].get("dropout") and all(x["content"].startswith("<|") for x in spec["added_tokens"])
        self.letters = Tokenizer(self.whole.model)
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most_words = most_words
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.ids, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        # of each known piece: where its ids begin, how many they are, where its bytes begin, how many they are
        self.at, self.sizes, self.bytes_at, self.lens = (np.zeros(0, np.int64) for _ in range(4))

    def _encode_letters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of pieces of letters, sent to the library in lines of ``step`` pieces."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lens = ends - starts
        line = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
        line[ragged(np.cumsum(lens + 1) - lens - 1, lens)] = data[ragged(starts, lens)]
        cuts = np.concatenate(([0], np.cumsum(lens + 1)[step - 1 :: step], [len(line)]))
        raw = line.tobytes()
        ids, words = [], []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                got = self.letters.encode(raw[a:b].decode(), add_special_tokens=False)
                ids.append(np.array(got.ids, np.uint32))
                words.append(np.array(got.word_ids, np.int64) + k * step)
        return np.concatenate(ids), np.bincount(np.concatenate(words), minlength=len(lens))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, hashes: np.ndarray) -> None:
        ids, sizes = self._encode_letters(data, starts[plain], ends[plain])
        raw = data.tobytes()
        rest = self.whole.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True)], add_special_tokens=False)
        more = [np.array(e.ids, np.uint32) for e in rest]
        sizes = np.concatenate((sizes, np.fromiter(map(len, more), np.int64, len(more))))
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate((self.ids, ids, *more))
        starts, ends = (np.concatenate((x[plain], x[~plain])) for x in (starts, ends))
        lens = ends - starts
        bytes_at = len(self.pool) + np.cumsum(lens) - lens
        self.pool = np.concatenate((self.pool, data[ragged(starts, lens)]))
        known = np.concatenate((self.hashes, hashes[plain], hashes[~plain]))
        order = np.argsort(known)
        self.hashes = known[order]
        self.at, self.sizes, self.bytes_at, self.lens = (np.concatenate(x)[order] for x in ((self.at, at), (self.sizes, sizes), (self.bytes_at, bytes_at), (self.lens, lens)))

    def _strangers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which pieces aren't the ones that taught the ids of their hashes."""
        lens = ends - starts
        out = self.lens[known] != lens
        long = np.flatnonzero(~out & (lens > 8))
        if len(long):
            same = data[ragged(starts[long], lens[long])] == self.pool[ragged(self.bytes_at[known[long]], lens[long])]
            out[long] = ~np.logical_and.reduceat(same, np.cumsum(lens[long]) - lens[long])
        return np.flatnonzero(out)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, one after another; and where each text's begin and end."""
        text = utf8(texts, lower=False)
        odd = text.data >= 0xCC
        odd[:-1] |= (text.data[:-1] == 60) & (text.data[1:] == 124)  # "<|"
        plain = np.full(len(texts), self.cuts)
        plain[np.searchsorted(text.offsets, np.flatnonzero(odd), "right") - 1] = False
        if len(self.hashes) > self.most_words:
            self._forget()
        found = self._encode(texts, text, plain, end_id)
        while isinstance(found, np.ndarray):
            plain[found] = False
            found = self._encode(texts, text, plain, end_id)
        return found

    def _encode(self, texts: pa.Array, text: Text, plain: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        """Ids and where each text's begin and end; or the texts marked ``plain`` that have to be encoded whole."""
        n = len(texts)
        # texts that aren't plain lose their bytes here and get their ids below
        sizes = np.where(plain, np.diff(text.offsets), 0)
        data = text.data if plain.all() else text.data[np.repeat(plain, np.diff(text.offsets))]
        text = Text(LOWER[data], np.concatenate(([0], np.cumsum(sizes))))
        starts, ends, letters = self._pieces(text)
        by, slot = np.unique(range_hashes(text.data, starts, ends), return_inverse=True)
        first = np.empty(len(by), np.int64)
        first[slot[::-1]] = np.arange(len(slot))[::-1]
        new = ~np.isin(by, self.hashes, assume_unique=True)
        if new.any():
            self._learn(text.data, starts[first[new]], ends[first[new]], letters[first[new]], by[new])
        known = np.searchsorted(self.hashes, by)[slot]
        strange = self._strangers(text.data, starts, ends, known)
        if len(strange):
            return np.unique(np.searchsorted(text.offsets, starts[strange], "right") - 1)
        per_piece = self.sizes[known]
        piece_ends = np.concatenate(([0], np.cumsum(per_piece)))
        counts = np.diff(piece_ends[np.searchsorted(starts, text.offsets)])
        others = np.flatnonzero(~plain)
        coded = self.whole.encode_batch_fast([texts[i].as_py() or "" for i in others.tolist()], add_special_tokens=False) if len(others) else []
        own = counts.copy()
        counts[others] = [len(e.ids) for e in coded]
        last = np.cumsum(counts + 1)
        begins = last - counts - 1
        out = np.full(int(last[-1]) if n else 0, end_id, np.uint32)
        out[ragged(begins, own)] = self.ids[ragged(self.at[known], per_piece)]
        for i, e in zip(others.tolist(), coded, strict=True):
            out[begins[i] : begins[i] + counts[i]] = e.ids
        return out, np.concatenate(([0], last))

    @staticmethod
    def _pieces(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin and end, and whether each is all letters."""
        if not len(text.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        kind = np.where(_plain_letters(text.data), 1, _KIND[text.data])
        solid = kind > 0
        head = np.zeros(len(solid) + 1, bool)
        head[text.offsets] = True
        cut = (kind[1:] != kind[:-1]) & ((np.maximum(kind[1:], kind[:-1]) < 4) | (np.minimum(kind[1:], kind[:-1]) == 0))
        head[1:-1] |= cut & ~((text.data[:-1] == 39) & (kind[1:] == 1))
        tail = head[1:] | np.concatenate((~solid[1:], [True]))
        starts = np.flatnonzero(head[:-1] & solid)
        # white space up to the next piece is kind 0, so the largest kind is the piece's own
        letters = np.maximum.reduceat(kind, starts) == 1 if len(starts) else np.zeros(0, bool)
        return starts, np.flatnonzero(tail & solid) + 1, letters


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer: Spark's workers stay for further tasks, and each load of a vocabulary leaves memory behind that doesn't come back."""
    return WordTokenizer(path)


def id_space(path: str, end_id: int) -> int:
    """One more than the largest id."""
    return max(*Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), end_id) + 1


def _kind(space: int) -> str:
    return "<u2" if space <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are little-endian numbers of 16 bits, or 32 if the vocabulary needs them, packed with zstd."""
    kind = _kind(id_space(path, end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, squeeze = word_tokenizer(path), zstandard.ZstdCompressor(1)
        for batch in text_slices(batches, "text", 1 << 19):
            ids, at = tokenizer.encode(batch.column(1), end_id)
            ids = ids.astype(kind)
            packed = [squeeze.compress(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id under ``size`` occurs; so many sums at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, open_ = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                raw = b"".join(open_.decompress(x) for x in batch.column(0)[k : k + 500].to_pylist())
                counts += np.bincount(np.frombuffer(raw, _kind(size)), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


class _Writer:
    """One file: written under a temporary name, given its own name when whole."""

    def __init__(self, folder: str, name: str, lengths: np.ndarray):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.temp = name, f"_{name}.{TaskContext.get().taskAttemptId()}"
        self.files.create_dir(self.folder, recursive=True)
        self.out = self.files.open_output_stream(f"{self.folder}/{self.temp}")
        self.lengths, self.codes = lengths, canonical_codes(lengths)
        self.checks: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.n_ids = self.bits_at = 0
        self.left = np.zeros(0, np.uint32)
        self.out.write(MAGIC)

    def add(self, docs: list[tuple], ids: np.ndarray, last: bool = False) -> None:
        """Codes whole blocks; what is left of a block waits for more."""
        self.docs += docs
        ids = np.concatenate((self.left, ids))
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        bits, at = encode(ids[:n], self.codes, self.lengths)
        self.checks.append(at + self.bits_at * 8)
        self.out.write(bits)
        self.bits_at += len(bits)
        self.n_ids += n
        self.left = ids[n:]

    def close(self) -> tuple[str, int, int]:
        self.add([], np.zeros(0, np.uint32), last=True)
        checks = np.concatenate(self.checks).astype("<u8").tobytes()
        ids = [(d is None, d or 0) for d, _ in self.docs]
        index = b"".join((np.array([x for x, _ in ids], np.uint8).tobytes(), np.array([x for _, x in ids], "<i8").tobytes(), np.array([n for _, n in self.docs], "<u4").tobytes()))
        parts = [zlib.compress(self.lengths.tobytes()), zlib.compress(index), zlib.compress(checks)]
        tail = json.dumps({"docs": len(self.docs), "ids": self.n_ids, "bits": self.bits_at, "parts": [len(p) for p in parts]}).encode()
        for p in (*parts, tail, struct.pack("<I", len(tail)), MAGIC):
            self.out.write(p)
        self.out.close()
        self.files.move(f"{self.folder}/{self.temp}", f"{self.folder}/{self.name}")
        return self.name, len(self.docs), self.n_ids


def read_file(uri: str) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of one file."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        data = f.read()
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError(f"not a whole token file: {uri}")
    (n,) = struct.unpack("<I", data[-12:-8])
    tail = json.loads(data[-12 - n : -12])
    parts, at = [], 8 + tail["bits"]
    for size in tail["parts"]:
        parts.append(zlib.decompress(data[at : at + size]))
        at += size
    lengths, index, checks = np.frombuffer(parts[0], np.uint8), parts[1], np.frombuffer(parts[2], "<u8")
    k = tail["docs"]
    null, ids = np.frombuffer(index[:k], np.uint8), np.frombuffer(index[k : 9 * k], "<i8")
    per_doc = np.frombuffer(index[9 * k :], "<u4").astype(np.int64)
    return [None if z else int(x) for z, x in zip(null, ids, strict=True)], per_doc, Decoder(lengths).decode(data[8 : 8 + tail["bits"]], checks, tail["ids"])


def write_tokens(tokens: DataFrame, folder: str, space: int, file_ids: int = 4 << 20) -> DataFrame:
    """Writes token files of ids under ``space`` and gives their manifest (part, seq, file, n_docs, n_ids), itself a table in ``folder``.

    Rows are range-sorted by (doc_id, hash of ids), nulls first, into parts of about ``file_ids`` ids, and a
    part goes on to a new file past that size. The codes come from the counts of all ids. A file
    has its name only when whole, and a repeated task replaces it by the same bytes.
    """
    counts = id_counts(tokens, space)
    lengths = code_lengths(counts)
    shared = tokens.sparkSession.sparkContext.broadcast(lengths)
    parts = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // file_ids + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, writer, open_ = TaskContext.get().partitionId(), [], None, zstandard.ZstdDecompressor()
        held: list[np.ndarray] = []
        docs: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(np.frombuffer(open_.decompress(ids.as_py()), _kind(space)))
                docs.append((doc, len(held[-1])))
                size += len(held[-1])
                if size >= 1 << 16:
                    writer = writer or _Writer(folder, f"part-{part:06d}-{len(rows):04d}.tok", shared.value)
                    writer.add(docs, np.concatenate(held))
                    held, docs, size = [], [], 0
                    if writer.n_ids >= file_ids:
                        rows.append((part, len(rows), *writer.close()))
                        writer = None
        if docs or writer:
            writer = writer or _Writer(folder, f"part-{part:06d}-{len(rows):04d}.tok", shared.value)
            if docs:
                writer.add(docs, np.concatenate(held))
            rows.append((part, len(rows), *writer.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "file", "n_docs", "n_ids"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]  # Spark samples these to deal out the ranges
    placed = tokens.select("doc_id", "ids").repartitionByRange(parts, *by).sortWithinPartitions(*by, "ids")
    placed.mapInArrow(tidy(run), "part int, seq int, file string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return tokens.sparkSession.read.parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files that ``manifest`` names."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, per_doc, ids = read_file(f"{folder}/{name}")
                ends = np.cumsum(per_doc)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - per_doc).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - per_doc), pa.array(per_doc), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n, "file").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes every whole text, writes the ids as files, and gives what reading them back finds.

    Columns doc_id, start (ids of all documents before), n_tokens (with the end id), ids_crc32.
    Null and empty texts have the end id alone; repeated ids each keep their row, ordered by their
    ids; a null id comes first. An empty table writes no file and gives no rows.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(stored(tokenize(docs, path, end_id, id_col, text_col), "ids"), folder, id_space(path, end_id)), folder)
