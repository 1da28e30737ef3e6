"""Shared storage for intermediate tables, and byte-level text batches in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once.
SLICE_BYTES = 2 << 20
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below a folder of this application in the one that ``spark.checkpoint.dir`` names for driver and executors.

    Only a local session may lack that setting (as in tests, in one process); it gets a folder in /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.get(spark.sparkContext.applicationId)
        if not base:
            base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/wavecrest-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has put below its scratch folder; results that weren't written elsewhere are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x").rsplit("/", 1)[0])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to shared storage and read again: its lineage is cut there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for tables that nothing reads any more."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release() -> None:
    """Gives memory that numpy and Arrow have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and ``release`` at its end, as Spark's workers stay for further tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of an id as text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece has one row, or at most ``limit`` bytes in ``column`` and ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _offsets(batch.column(batch.schema.get_field_index(column)))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
            last = min(max(last, first + 1), first + rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


class Text(NamedTuple):
    """UTF-8 of texts, one after another; text i is ``data[offsets[i]:offsets[i + 1]]``; nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, lower-case a-z and all of UTF-8 beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def utf8(texts: pa.Array, lower: bool = True) -> Text:
    """The bytes of a string column, with A-Z in lower case if ``lower``."""
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    data, offsets = _offsets(texts)
    data = data[offsets[0] : offsets[-1]]
    return Text(LOWER[data] if lower else data, offsets - offsets[0])


class Words(NamedTuple):
    """Words as byte ranges; ``first[i]:first[i + 1]`` are those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(text: Text, of: np.ndarray = WORD) -> Words:
    """Maximal runs of bytes that ``of`` marks, within each text."""
    if not len(text.data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(text.offsets), np.int64))
    mark = of[text.data]
    cut = np.zeros(len(mark) + 1, bool)
    cut[text.offsets] = True
    before = np.concatenate(([False], mark[:-1])) & ~cut[:-1]
    after = np.concatenate((mark[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, text.offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer ranges go to XXH64, one at a time.
_LONG = 64


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal wherever the bytes are: eight bytes at a time, each mixed with all before."""
    lens = ends - starts
    out = mix(lens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    some = np.flatnonzero(lens <= _LONG)
    at, left = starts[some], lens[some]
    while len(some):
        out[some] = mix(out[some] + (eights[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(lens > _LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), 1)
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then those of the next."""
    if not counts.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
