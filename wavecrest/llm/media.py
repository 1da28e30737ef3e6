"""Media columns: images in archive files, written by tasks and read by a data source of byte ranges."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavecrest.llm.common import scratch

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(data: bytes, level: int = 1) -> bytes:
    """Bytes as an 8-bit grey PNG of 64 samples a row; zeros fill the last row, and no data is one row.

    The number of bytes before filling is kept in a text chunk.
    """
    rows = max(1, -(-len(data) // WIDTH))
    image = np.zeros((rows, WIDTH + 1), np.uint8)
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    image[:, 1:] = flat.reshape(rows, WIDTH)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0))
    return _SIGNATURE + head + _chunk(b"tEXt", b"length\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(image.tobytes(), level)) + _chunk(b"IEND", b"")


def png_decode(media: bytes) -> tuple[np.ndarray, int]:
    """(samples by row and column, number of bytes before filling) of an image of png_encode."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, rows, length, packed = 8, 0, 0, -1, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(media[at + 4 : at + 8 + n]):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey is stored here")
        elif kind == b"tEXt" and data.startswith(b"length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    image = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)
    if image[:, 0].any():
        raise ValueError("only unfiltered rows are stored here")
    return image[:, 1:], length


def average_hash(image: np.ndarray) -> str:
    """16 hex digits: which of 8 by 8 blocks are brighter than the image."""
    rows = len(image)
    sums = np.concatenate((np.zeros((1, 8)), np.cumsum(image.reshape(rows, 8, -1).mean(axis=2), axis=0)))
    first = np.arange(8) * rows // 8
    last = np.maximum(np.arange(1, 9) * rows // 8, first + 1)
    blocks = (sums[last] - sums[first]) / (last - first)[:, None]
    return np.packbits(blocks > blocks.mean()).tobytes().hex()


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 64 << 20) -> DataFrame:
    """Stores every text as an image in tar archives of ``folder``; gives the manifest (archive, members, bytes).

    A task writes archives of about ``archive_bytes`` bytes under temporary names, each with an
    index of its members' offsets beside it, and renames both when whole, so that a repeated task
    replaces them by the same bytes. A null text is an empty one; a null id is named ``null``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        context, rows, out, at, offsets = TaskContext.get(), [], None, 0, []

        def close() -> None:
            out.write(bytes(1024))
            out.close()
            name = f"part-{context.partitionId():06d}-{len(rows):04d}"
            with files.open_output_stream(f"{path}/_index.{context.taskAttemptId()}") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            files.move(f"{path}/_index.{context.taskAttemptId()}", f"{path}/{name}.idx")
            files.move(f"{path}/_archive.{context.taskAttemptId()}", f"{path}/{name}.tar")
            rows.append({"archive": f"{name}.tar", "members": len(offsets), "bytes": at})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out, at, offsets = files.open_output_stream(f"{path}/_archive.{context.taskAttemptId()}"), 0, []
                media = png_encode((text.as_py() or "").encode("utf-8", "surrogatepass"))
                info = tarfile.TarInfo(f"{'null' if doc is None else doc}.png")
                info.size = len(media)
                member = info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512)
                out.write(member)
                offsets.append(at)
                at += len(member)
                if at >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen.mapInArrow(run, "archive string, members long, bytes long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


class ByteRange(InputPartition):
    def __init__(self, archive: str, first: int, last: int):
        self.archive, self.first, self.last = archive, first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges of the bytes of the archives that the folder's manifest names, or of all if it has none; only names and sizes come to the driver."""
        files, path = fs.FileSystem.from_uri(self.folder)
        if files.get_file_info(f"{path}/manifest").type == fs.FileType.Directory:
            rows = dataset(f"{path}/manifest", filesystem=files, format="parquet").to_table(columns=["archive", "bytes"])
            found = sorted((f"{path}/{name}", size) for name, size in zip(*(rows.column(k).to_pylist() for k in range(2)), strict=True))
        else:
            found = sorted((x.path, x.size) for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.extension == "tar")
        return [ByteRange(name, a, min(a + self.range_bytes, size)) for name, size in found for a in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def _member(self, files: fs.FileSystem, archive: str, offset: int) -> tuple[str, int, bytes | None, int, str | None]:
        """(name, size, bytes, attempts, error) of the member at an offset, tried by itself."""
        error = None
        for attempt in range(1, self.attempts + 1):
            try:
                if self._open is None:
                    self._open = files.open_input_file(archive)
                info = tarfile.TarInfo.frombuf(self._open.read_at(512, offset), "utf-8", "strict")
                data = self._open.read_at(info.size, offset + 512)
                if len(data) != info.size:
                    raise OSError(f"{len(data)} of {info.size} bytes")
                return info.name, info.size, data, attempt, None
            except (OSError, tarfile.HeaderError, UnicodeError) as e:
                error, self._open = f"{type(e).__name__}: {e}", None
                if attempt < self.attempts:
                    time.sleep(0.1 * 2**attempt)
        return "", 0, None, self.attempts, error

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """The members that begin in the range; one that can't be read has a null payload and its error."""
        if not partition.archive:
            return
        files = fs.FileSystem.from_uri(self.folder)[0]
        with files.open_input_file(partition.archive[:-4] + ".idx") as f:
            offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
        self._open = None
        names = ["archive", "member", "offset", "size", "payload", "attempts", "error"]
        rows, held = [], 0
        for offset in offsets[(offsets >= partition.first) & (offsets < partition.last)].tolist():
            name, size, data, attempts, error = self._member(files, partition.archive, offset)
            rows.append((partition.archive, name, offset, size, data, attempts, error))
            held += size
            if held >= self.batch_bytes:
                yield _batch(rows, names)
                rows, held = [], 0
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: one row for each member of its tar archives."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, size long, payload binary, attempts int, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def media_features(members: DataFrame) -> DataFrame:
    """What the stored bytes of each member say of its payload; a member that couldn't be read raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, media, error in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if error:
                    raise OSError(f"{member}: {error}")
                image, length = png_decode(media)
                payload = image.tobytes()
                name = member.removesuffix(".png")
                rows.append((None if name == "null" else int(name), length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), average_hash(image)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return members.select("member", "payload", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores every whole text as an image, reads the archives back, and gives one row a text.

    Null and empty texts are one row of 64 zeros; equal texts give equal values; repeated ids each
    keep their row; an empty table gives none; other columns are ignored.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    write_archives(docs, folder, id_col, text_col)
    return media_features(read_archives(docs.sparkSession, folder))
