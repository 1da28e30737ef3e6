"""A Spark data source of the matrices in NPY and Level 5 MAT files: a large file is many tasks' work, and no task holds more than a range of it.

Rows are chunks (file, subject, task, ch_idx, start, n, signal): the samples of a channel from ``start`` on, of ``n`` in all. A file of up to
``piece_bytes`` is read by one task, with others of its size. A larger one is planned from its headers: an uncompressed matrix is cut into ranges of bytes, a compressed
variable is inflated as a stream by a task of its own, and files and variables of other subjects or tasks than those named are never read.

They are named by options, not by filters that Spark pushes: Spark 4.1 keeps the plan of a filtered read and uses it again for other reads of the same DataFrame, whose rows are
then missing.
"""

from __future__ import annotations

import fnmatch
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "file string, subject string, task string, ch_idx int, start long, n long, signal array<double>, error string"
CHUNK = 16_384
PIECE = 32 << 20
#: What a damaged file raises; an error of the file system isn't among them, so Spark repeats the task.
DAMAGED = (ValueError, struct.error, zlib.error, EOFError, StopIteration, KeyError, IndexError)
#: Number types of MAT elements.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_ARROW = pa.schema([("file", pa.string()), ("subject", pa.string()), ("task", pa.string()), ("ch_idx", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("signal", pa.list_(pa.float64())), ("error", pa.string())])


@dataclass(frozen=True)
class Matrix:
    """A matrix in a file and the part of it that is wanted: samples ``lo`` to ``hi`` of channels ``first`` to ``last``."""

    file: str
    subject: str
    task: str
    channels: int
    n: int
    by_sample: bool  # a sample's channels lie together, else a channel's samples do
    dtype: str
    at: int  # where the numbers begin, in the inflated element if it is packed
    packed: tuple[int, int] | None = None  # place and length of the compressed element
    lo: int = 0
    hi: int = 0
    first: int = 0
    last: int = 0

    @property
    def size(self) -> int:
        return np.dtype(self.dtype).itemsize

    @property
    def nbytes(self) -> int:
        return self.channels * self.n * self.size

    def pieces(self, piece: int, chunk: int) -> Iterator[Matrix]:
        """Parts of about ``piece`` bytes whose ends are ends of chunks; a compressed matrix is one."""
        if self.packed or self.nbytes <= piece:
            yield self
        elif self.by_sample:
            step = max(1, piece // (self.channels * self.size * chunk)) * chunk
            yield from (replace(self, lo=lo, hi=min(lo + step, self.n)) for lo in range(0, self.n, step))
        elif self.n * self.size <= piece:
            step = piece // (self.n * self.size)
            yield from (replace(self, first=c, last=min(c + step, self.channels)) for c in range(0, self.channels, step))
        else:
            step = max(1, piece // (self.size * chunk)) * chunk
            yield from (replace(self, first=c, last=c + 1, lo=lo, hi=min(lo + step, self.n)) for c in range(self.channels) for lo in range(0, self.n, step))


def _of(file: str, subject: str, task: str, shape: tuple[int, int], by_sample: bool, dtype: str, at: int, packed: tuple[int, int] | None = None) -> Matrix:
    return Matrix(file, subject, task, *shape, by_sample, dtype, at, packed, 0, shape[1], 0, shape[0])


def file_subject(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])


def mat_subject(path: str) -> str:
    m = re.search(r"_Sub_(\d+)", path)
    return m[1] if m else file_subject(path)


def mat_task(name: str) -> str | None:
    """``trial_STATE`` or ``trial_rest`` from a variable's name, whichever way it is ordered."""
    rest = re.fullmatch(r"(?:.*_)?RST([12])", name)
    if rest:
        return f"{rest[1]}_rest"
    for pattern in (r"(?:.*_)?([123])_(IDG|IDE|IDR)", r"(?:.*_)?(IDG|IDE|IDR)_([123])"):
        m = re.fullmatch(pattern, name)
        if m:
            trial, state = (m[1], m[2]) if m[1].isdigit() else (m[2], m[1])
            return f"{trial}_{state}"
    return None


def npy_matrices(source, size: int, file: str) -> list[Matrix]:
    """The one matrix of an NPY file, (samples, channels) or (samples,)."""
    version = np.lib.format.read_magic(source)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
    if len(shape) not in (1, 2):
        raise ValueError(f"{len(shape)} dimensions")
    if dtype.kind not in "biuf":
        raise ValueError(f"numbers of type {dtype}")
    n, channels = (*shape, 1)[:2]
    if source.tell() + n * channels * dtype.itemsize > size:
        raise ValueError("the file ends before its numbers do")
    return [_of(file, file_subject(file), "npy", (channels, n), not fortran, dtype.str, source.tell())]


def _tag(raw: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(type, length, place of the data, place of the next element); a small element has its length beside its type."""
    kind, size = struct.unpack_from(order + "II", raw, at)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + size + -size % 8


def _mat_variable(raw: bytes, order: str, file: str, at: int, packed: tuple[int, int] | None) -> tuple[str, Matrix] | None:
    """(name, matrix) of an element that begins with ``raw``; None if it holds no numbers in two dimensions. Too short a ``raw`` is a struct.error."""
    kind, length, data, _ = _tag(raw, 0, order)
    if kind != 14 or not length:
        return None
    flags, _, flags_at, then = _tag(raw, data, order)
    _, dims, dims_at, then = _tag(raw, then, order)
    _, name_size, name_at, then = _tag(raw, then, order)
    group = struct.unpack_from(order + "I", raw, flags_at)[0] & 0xFF
    if flags != 6 or not 6 <= group <= 15 or dims != 8:
        return None
    rows, columns = struct.unpack_from(order + "ii", raw, dims_at)
    name = struct.unpack_from(f"{name_size}s", raw, name_at)[0].decode("ascii")
    number, size, numbers_at, _ = _tag(raw, then, order)
    if number not in MAT_TYPES:
        return None
    dtype = np.dtype(order + MAT_TYPES[number])
    if rows * columns * dtype.itemsize > size:
        raise ValueError(f"variable {name!r} ends before its numbers do")
    # fewer channels than samples; columns lie together
    wide = rows <= columns
    return name, _of(file, mat_subject(file), name, (rows, columns) if wide else (columns, rows), wide, dtype.str, numbers_at + (0 if packed else at), packed)


def mat_matrices(source, size: int, file: str, head: int = 4_096) -> list[Matrix]:
    """Variables named after tasks if there are any, else all of two dimensions not beginning with ``__``; only the beginnings of elements are read."""
    if size < 128:
        raise ValueError("shorter than a header")
    order = "<" if source.read(128)[126:128] == b"IM" else ">"
    found, at = [], 128
    while at + 8 <= size:
        source.seek(at)
        beginning = source.read(head)
        kind, length, data, then = _tag(beginning, 0, order)
        if data + at + length > size:
            raise ValueError("the file ends within an element")
        if kind == 15:
            then = 8 + length  # compressed elements aren't padded
            beginning = zlib.decompressobj().decompress(beginning[8 : 8 + length], head)
        got = _mat_variable(beginning, order, file, at, (at + 8, length) if kind == 15 else None)
        found += [got] if got else []
        at += then
    tasks = [replace(m, task=mat_task(name)) for name, m in found if mat_task(name)] or [m for name, m in found if not name.startswith("__")]
    if not tasks:
        raise ValueError("no variable of two dimensions")
    return tasks


KINDS: dict[str, tuple[Callable, Callable[[str], str]]] = {"npy": (npy_matrices, file_subject), "mat": (mat_matrices, mat_subject)}


def _inflated(source, place: tuple[int, int], block: int = 1 << 20) -> Iterator[bytes]:
    source.seek(place[0])
    left, stream = place[1], zlib.decompressobj()
    while not stream.eof:
        raw = stream.unconsumed_tail
        if not raw:
            raw = source.read(min(block, left))
            left -= len(raw)
        if not raw:
            raise ValueError("the compressed numbers end early")
        yield stream.decompress(raw, block)


class _Bytes:
    """Reads so many bytes at a time from blocks of any length."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            block = next(self.blocks, None)
            if block is None:
                raise ValueError("the numbers end early")
            self.held += block
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def finish(self) -> None:
        for _ in self.blocks:
            pass


def chunks(source, m: Matrix, chunk: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(channel, start, samples) of a part. The last chunks of a compressed matrix's channels come after its checksum holds, so no channel of a damaged one is whole."""
    packed = None
    if m.packed:
        packed = _Bytes(_inflated(source, m.packed))
        packed.take(m.at)

    def read(at: int, count: int) -> np.ndarray:
        if packed:
            raw = packed.take(count * m.size)
        else:
            source.seek(m.at + at * m.size)
            raw = source.read(count * m.size)
        return np.frombuffer(raw, m.dtype, count).astype(float)

    def each() -> Iterator[tuple[int, int, np.ndarray]]:
        if m.by_sample:
            for lo in range(m.lo, m.hi, chunk):
                n = min(chunk, m.hi - lo)
                block = read(lo * m.channels, n * m.channels).reshape(n, m.channels).T
                yield from ((c, lo, block[c]) for c in range(m.channels))
        else:
            yield from ((c, lo, read(c * m.n + lo, min(chunk, m.hi - lo))) for c in range(m.first, m.last) for lo in range(m.lo, m.hi, chunk))

    if not m.n:
        yield from ((c, 0, np.zeros(0)) for c in range(m.channels))
        return
    if not packed:
        yield from each()
        return
    held = []
    for row in each():
        if row[1] + chunk < m.hi:
            yield row
        else:
            held.append(row)
    packed.finish()
    yield from held


def whole(source, m: Matrix) -> Iterator[tuple[int, int, np.ndarray]]:
    """(channel, 0, all samples) of a matrix of bounded size."""
    signals = np.empty((m.channels, m.n))
    for c, lo, x in chunks(source, m, CHUNK):
        signals[c, lo : lo + len(x)] = x
    return ((c, 0, x) for c, x in enumerate(signals))


@dataclass
class Work(InputPartition):
    """Parts of large matrices, small files, or errors found while planning."""

    parts: tuple[Matrix, ...] = ()
    files: tuple[tuple[str, int], ...] = ()
    errors: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        super().__init__(None)


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before such a path)."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", path)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", m[2]) if m else path, ""
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner, path[: path.index(inner)] if inner in path else f"{m[1]}://"


def listed(path: str, kind: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a kind at a path, in a folder or by a pattern, in order; as in Spark, names that begin with ``_`` or ``.`` don't count."""
    system, inner, before = _system(path)
    parts = inner.rstrip("/").split("/")
    wild = next((k for k, x in enumerate(parts) if any(c in x for c in "*?[")), None)
    if wild is None:
        at = system.get_file_info(inner)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    else:
        deep = len(parts) - wild > 1
        infos = [i for i in system.get_file_info(fs.FileSelector("/".join(parts[:wild]) or "/", recursive=deep)) if _matches(i.path.split("/")[-(len(parts) - wild) :], parts[wild:]) and i.path.count("/") == len(parts) - 1]
    kept = [(before + i.path, i.size) for i in infos if i.type == fs.FileType.File and i.base_name[:1] not in "_." and i.extension.lower() == kind]
    return sorted(kept)


def _matches(names: list[str], patterns: list[str]) -> bool:
    return len(names) == len(patterns) and all(fnmatch.fnmatchcase(n, p) for n, p in zip(names, patterns, strict=True))


class MatrixReader(DataSourceReader):
    """Plans and reads the files and variables of the ``subjects`` and ``tasks`` named, all if none are; ``rows`` is ``chunks`` (all), ``whole`` (files of up to ``piece_bytes``, a row a channel) or ``parts`` (chunks of the larger files)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "npy")
        self.piece, self.chunk, self.rows = int(options.get("piece_bytes", PIECE)), int(options.get("chunk", CHUNK)), options.get("rows", "chunks")
        self.wanted = {c: set(json.loads(options[f"{c}s"])) for c in ("subject", "task") if options.get(f"{c}s")}

    def _asked(self, subject: str, task: str | None = None) -> bool:
        known = {"subject": subject} | ({"task": task} if task is not None else {})
        return all(v in self.wanted[c] for c, v in known.items() if c in self.wanted)

    def partitions(self) -> list[Work]:
        matrices, subject = KINDS[self.kind]
        found = [(f, n) for f, n in listed(self.path, self.kind) if self._asked(subject(f))]
        out: list[Work] = []
        if self.rows != "whole":
            for file, size in (x for x in found if x[1] > self.piece):
                system, inner, _ = _system(file)
                try:
                    with system.open_input_file(inner) as source:
                        planned = [p for m in matrices(source, size, file) if self._asked(m.subject, m.task) for p in m.pieces(self.piece, self.chunk)]
                except DAMAGED as e:
                    out.append(Work(errors=((file, f"{type(e).__name__}: {e}"),)))
                    continue
                out += [Work(parts=(p,)) for p in planned]
        if self.rows != "parts":
            group, total = [], 0
            for file, size in (x for x in found if x[1] <= self.piece):
                if group and total + size > self.piece:
                    out.append(Work(files=tuple(group)))
                    group, total = [], 0
                group.append((file, size))
                total += size + (1 << 20)  # opening a file costs something too
            out += [Work(files=tuple(group))] if group else []
        return out or [Work()]

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        matrices, subject = KINDS[self.kind]

        def failure(file: str, task: str | None, error: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": file, "subject": subject(file), "task": task, "error": f"{file.rsplit('/', 1)[-1]}: {error}"}], schema=_ARROW)

        def rows(source, m: Matrix) -> Iterator[pa.RecordBatch]:
            try:
                for c, start, x in whole(source, m) if self.rows == "whole" else chunks(source, m, self.chunk):
                    signal = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.ascontiguousarray(x)))
                    yield pa.RecordBatch.from_arrays([pa.array([m.file]), pa.array([m.subject]), pa.array([m.task]), pa.array([c], pa.int32()), pa.array([start], pa.int64()), pa.array([m.n], pa.int64()), signal, pa.array([None], pa.string())], schema=_ARROW)
            except DAMAGED as e:
                yield failure(m.file, m.task, f"{type(e).__name__}: {e}")

        for file, error in partition.errors:
            yield failure(file, None, error)
        for m in partition.parts:
            system, inner, _ = _system(m.file)
            with system.open_input_file(inner) as source:
                yield from rows(source, m)
        for file, size in partition.files:
            system, inner, _ = _system(file)
            with system.open_input_file(inner) as source:
                try:
                    planned = [m for m in matrices(source, size, file) if self._asked(m.subject, m.task)]
                except DAMAGED as e:
                    yield failure(file, None, f"{type(e).__name__}: {e}")
                    continue
                for m in planned:
                    yield from rows(source, m)


class Matrices(DataSource):
    """Options: path, kind (npy or mat), rows, piece_bytes, chunk, and subjects and tasks as lists in JSON."""

    @classmethod
    def name(cls) -> str:
        return "wavecrest_matrices"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(dict(self.options))
