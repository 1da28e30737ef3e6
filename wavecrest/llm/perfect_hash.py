"""Minimal perfect hashes over 64-bit keys in shards, stored with their keys and values, and sums of arrays by shard."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.common import mix, scratch, stored, tidy

#: Keys of a shard; with two values of 64 bits a shard is some 3 MB, and a worker keeps the last ones used, of ``_OPEN_BYTES`` together.
SHARD_KEYS, _OPEN_BYTES = 1 << 17, 48 << 20
_LEVEL = 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = mix(keys + np.uint64((level + 1) * _LEVEL & (1 << 64) - 1))
    return ((spread >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash(NamedTuple):
    """Different keys to 0, 1, ..., one less than their number.

    Level after level, keys that are alone in their place of a bit array of twice as many places stay there, and the others go
    on to the next; a key's number is the count of bits before its own. ``before`` has that count for each 64 bits.
    """

    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys of a perfect hash repeat")
        sizes, levels = [], []
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            at = _places(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            mark = np.zeros(size, bool)
            mark[at[alone]] = True
            levels.append(np.packbits(mark, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone]
        return cls.of(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @classmethod
    def of(cls, sizes: list[int], bits: np.ndarray) -> PerfectHash:
        ones = np.bitwise_count(bits).astype(np.int64)
        return cls(sizes, bits, np.cumsum(ones) - ones)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key that was built in; another key gets any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _places(keys[left], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            there = self.bits[word] >> bit & np.uint64(1) == 1
            w, b = word[there], bit[there]
            out[left[there]] = self.before[w] + np.bitwise_count(self.bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left, base = left[~there], base + size // 64
        return out


class Shard:
    """A stored shard: its perfect hash, and columns in the order of slots."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_file(path) as f, pa.ipc.open_file(f) as file:
            self.rows = file.read_all().combine_chunks()
        meta = self.rows.schema.metadata
        self.perfect = PerfectHash.of(np.frombuffer(meta[b"sizes"], "<i8").tolist(), np.frombuffer(meta[b"bits"], "<u8"))
        self.keys = self.numbers("h").view(np.uint64)

    def numbers(self, name: str) -> np.ndarray:
        column = self.rows.column(name)
        return column.chunk(0).to_numpy() if column.num_chunks else np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the stored ones show aren't here."""
        slot = self.perfect.slots(keys)
        there = slot >= 0
        there[there] = self.keys[slot[there]] == keys[there]
        return np.where(there, slot, -1)


_SHARDS: OrderedDict[str, Shard] = OrderedDict()


def _open(uri: str) -> Shard:
    found = _SHARDS.pop(uri, None) or Shard(uri)
    _SHARDS[uri] = found
    while len(_SHARDS) > 1 and sum(x.rows.nbytes for x in _SHARDS.values()) > _OPEN_BYTES:
        _SHARDS.popitem(last=False)
    return found


class Index(NamedTuple):
    """Where the shards of an index are, and the number of the first key of each; keys are numbered through all shards."""

    files: list[str]
    firsts: list[int]

    @property
    def size(self) -> int:
        """How many keys there are."""
        return self.firsts[-1]

    def shard(self, k: int) -> Shard:
        return _open(self.files[k])

    def parts(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions) for each shard number in ``which``."""
        if not len(which):
            return
        order = np.argsort(which, kind="stable")
        used, first = np.unique(which[order], return_index=True)
        for k, at in zip(used.tolist(), np.split(order, first[1:]), strict=True):
            yield k, at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that aren't in the index."""
        out = np.full(len(keys), -1, np.int64)
        if not self.size or not len(keys):
            return out
        for k, at in self.parts(shard_numbers(keys, len(self.files))):
            if not self.files[k]:
                continue
            slot = self.shard(k).find(keys[at])
            out[at] = np.where(slot >= 0, slot + self.firsts[k], -1)
        return out

    def read(self, numbers: np.ndarray, columns: list[str]) -> pa.Table:
        """The values of keys by their number."""
        owner = np.searchsorted(self.firsts, numbers, "right") - 1
        back, found = np.empty(len(numbers), np.int64), []
        for k, at in self.parts(owner):
            back[at] = np.arange(len(at)) + sum(map(len, found))
            found.append(self.shard(k).rows.select(columns).take(pa.array(numbers[at] - self.firsts[k])))
        return pa.concat_tables(found).take(pa.array(back)).combine_chunks()


def shard_numbers(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def write_shard(folder: str, shard: int, rows: pa.Table) -> str:
    """Writes ``rows`` in the order of the perfect hash of their column ``h``, and gives the file's name, which has the attempt in it: a repeated task leaves a file that nobody reads."""
    rows = rows.combine_chunks()
    h = rows.column("h").to_numpy().view(np.uint64)
    perfect = PerfectHash.build(h)
    order = np.empty(len(h), np.int64)
    order[perfect.slots(h)] = np.arange(len(h))
    rows = rows.take(pa.array(order)).combine_chunks()
    rows = rows.replace_schema_metadata({b"sizes": np.array(perfect.sizes, "<i8").tobytes(), b"bits": perfect.bits.tobytes()})
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    file = f"{shard:06d}-{TaskContext.get().taskAttemptId()}.arrow"
    with files.open_output_stream(f"{path}/{file}") as out, pa.ipc.new_file(out, rows.schema) as stream:
        stream.write_table(rows)
    return f"{folder}/{file}"


MANIFEST = "shard long, file string, n long"


def read_manifest(manifest: DataFrame, shards: int) -> Index:
    """The index of the shards that ``manifest`` lists, one row each; a shard without keys has no file."""
    found = {r.shard: r for r in stored(manifest, "manifest").collect()}
    return Index([found[k].file if k in found else "" for k in range(shards)], np.cumsum([0, *(found[k].n if k in found else 0 for k in range(shards))]).tolist())


def build_index(keys: DataFrame, name: str, shard_keys: int = SHARD_KEYS) -> Index:
    """An index of ``keys``, whose column ``h`` holds different evenly spread 64-bit numbers; the other columns are its values.

    A task builds a shard of about ``shard_keys`` keys and writes it to shared storage. The table of names is committed by Spark, and the driver sees one name a shard.
    """
    folder = scratch(keys.sparkSession, name)
    shards = max(1, -(-keys.count() // shard_keys))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"shard": [key[0].as_py()], "file": [write_shard(folder, key[0].as_py(), rows.drop_columns(["_shard"]))], "n": [len(rows)]})

    # the upper half of h times the number of shards, as shard_numbers has it
    dealt = keys.withColumn("_shard", F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(shards).cast("long"), 32))
    return read_manifest(dealt.groupBy("_shard").applyInArrow(write, MANIFEST), shards)


def index_rows(spark, index: Index, form: Callable[[int, Shard], pa.Table], schema: str) -> DataFrame:
    """What ``form`` makes of the first number and the rows of each shard, one task for some shards."""
    n = max(1, len(index.files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if k < len(index.files) and index.files[k]:
                    yield from form(index.firsts[k], index.shard(k)).to_batches()

    return spark.range(0, n, 1, min(n, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, schema)


def pack(counts: np.ndarray) -> bytes:
    """Counts in 1, 2, 4 or 8 bytes each, the width first, as zstd of all their first bytes, then all second ones and so on; zeros take next to nothing."""
    width = np.min_scalar_type(int(counts.max(initial=0))).itemsize
    planes = np.ascontiguousarray(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)


ARRAYS = "shard long, part int, counts binary"


class Counter:
    """A task's counts, an array for each shard touched; arrays leave when they take ``held_bytes`` together, and at the end."""

    def __init__(self, sizes: Callable[[int], int], held_bytes: int = 96 << 20):
        self.sizes, self.limit, self.held, self.size = sizes, held_bytes, {}, 0

    def add(self, shard: int, slots: np.ndarray) -> None:
        n = self.sizes(shard)
        if shard not in self.held:
            self.held[shard] = np.zeros(n, np.int64)
            self.size += 8 * n
        self.held[shard] += np.bincount(slots, minlength=n)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.held and (last or self.size >= self.limit):
            part = TaskContext.get().partitionId()
            for k, counts in self.held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part], pa.int32()), pa.array([pack(counts)], pa.binary())], names=["shard", "part", "counts"])
            self.held, self.size = {}, 0


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tree_sum(arrays: DataFrame, width: int = 64, most: int = (1 << 64) - 1, finish: Run = iter, schema: str = ARRAYS) -> DataFrame:
    """(shard, part, counts): one array for each shard, the sum of its rows' or ``most`` where that is less; or what ``finish`` makes of such rows in the same worker. Parts are added up in ``width`` branches first, so
    no task gets more than a branch of a shard; a task has one array in memory, however many it adds."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([pack(total)], pa.binary())], names=["shard", "part", "counts"])

        for batch in batches:
            for shard, part, counts in zip(*(batch.column(k) for k in range(3)), strict=True):
                key = (shard.as_py(), part.as_py())
                if key != at:
                    if at is not None:
                        yield row()
                    at, total = key, unpack(counts.as_py())
                else:
                    total += unpack(counts.as_py())
                    np.minimum(total, np.uint64(most), out=total)
        if at is not None:
            yield row()

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return finish(add(batches))

    for branch, run, kind in ((F.pmod("part", F.lit(width)), add, ARRAYS), (F.lit(0), end, schema)):
        level = arrays.select("shard", branch.cast("int").alias("part"), "counts")
        arrays = level.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(tidy(run), kind)
    return arrays
