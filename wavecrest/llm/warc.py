"""WARC archives: a deterministic sharded writer with revisit records, and a reader that checks digests."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.common import scratch, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A time that never changes, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
#: A record's headers have about so many bytes.
HEAD_BYTES = 512


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: the page's response, or a revisit that names the page with the same payload."""
    digest = _sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's values, from its headers and block; digests are computed again and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if fields["WARC-Type"] == "response" and (_sha1(payload) != fields["WARC-Payload-Digest"] or len(payload) != length):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    page, other = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return {
        "page_id": page and int(page),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": other and int(other),
        "url": fields.get("WARC-Target-URI"),
    }


#: At most so many parts, so what the driver counts and sends out is bounded; beyond, parts grow with the table.
MOST_PARTS = 1 << 14
#: Ranges of ids that are counted at first; a range that is larger than a part is cut in 16 again, at most 12 times, and no more than ``MOST_PARTS`` ranges are.
FIRST_RANGES = 1 << 16


def _prefix(step: int):
    """An id's leading bits, all but ``step`` of them, in the order of ids."""
    return F.shiftrightunsigned(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63))), step)


def _signed(k: int) -> int:
    return k - (k >> 63 << 64)


class Parts(NamedTuple):
    """For each number of bits left out, (prefix, first part, pieces) of ranges of ids; the pieces that rows of no id have; how many parts there are; what is counted in one; ranges that came to the driver."""

    ranges: dict[int, list[tuple[int, int, int]]]
    null_pieces: int
    n: int
    size: int
    seen: int


def plan_parts(rows: DataFrame, size: int, weight: Column) -> Parts:
    """Parts of page_id (nulls first) of about ``size`` each in sums of ``weight``; they depend on ids and weights alone, however the rows are dealt.

    Weights are summed up by leading bits of ids, in at most ``FIRST_RANGES`` ranges, and ranges of more than ``size`` again by
    further bits; neighbouring ranges share a part. Only these sums come to the driver, however many rows there are. An id, or null, of more than ``size`` has several parts.
    """
    held = rows.select("page_id", weight.alias("_w"))
    low, high, total, nulls = held.agg(F.min("page_id"), F.max("page_id"), F.sum("_w"), F.sum(F.when(F.col("page_id").isNull(), F.col("_w")))).first()
    total, nulls = total or 0, nulls or 0
    size = max(size, -(-total // MOST_PARTS))
    ranges: list[tuple[int, int, int]] = []
    seen = 0
    if low is not None:
        bits = (low ^ high if low >= 0 or high < 0 else -1) & (1 << 64) - 1
        asked = min(16 * (total - nulls) // size + 1, FIRST_RANGES)
        step, chosen = max(0, bits.bit_length() - asked.bit_length()), held.where(F.col("page_id").isNotNull())
        while True:
            sums = [(r[0] & (1 << 64) - 1, r[1]) for r in chosen.groupBy(_prefix(step).alias("k")).agg(F.sum("_w")).collect()]
            seen += len(sums)
            ranges += [(k << step, step, n) for k, n in sums if n <= size or not step]
            large = [(_signed(k),) for k, n in sums if n > size and step]
            if not large:
                break
            # fewer than MOST_PARTS ranges can be larger than a part
            again = F.broadcast(rows.sparkSession.createDataFrame(large, "_large long"))
            chosen, step = held.join(again, _prefix(step) == F.col("_large"), "left_semi"), max(0, step - 4)
    null_pieces = max(1, -(-nulls // size))
    part, filled, found = null_pieces, 0, {}
    for first, step, n in sorted(ranges):
        if filled and filled + n > size:
            part, filled = part + 1, 0
        found.setdefault(step, []).append((_signed(first >> step), part, max(1, -(-n // size))))
        part, filled = (part + -(-n // size), 0) if n > size else (part, filled + n)
    return Parts(found, null_pieces, part + 1, size, seen)


def in_parts(rows: DataFrame, parts: Parts, row_hash: Column) -> DataFrame:
    """``rows`` with ``part``; rows of an id with several parts are dealt to them in the order of ``row_hash``."""
    out = rows.withColumn("_part", F.when(F.col("page_id").isNull(), F.struct(F.lit(0).alias("part"), F.lit(parts.null_pieces).alias("pieces"))))
    for step, own in parts.ranges.items():
        table = rows.sparkSession.createDataFrame(own, "_key long, _first int, _pieces int")
        out = out.withColumn("_prefix", _prefix(step)).join(F.broadcast(table), F.col("_prefix") == F.col("_key"), "left")
        out = out.withColumn("_part", F.coalesce("_part", F.when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("part"), F.col("_pieces").alias("pieces"))))).drop("_prefix", "_key", "_first", "_pieces")
    piece = F.shiftright((F.shiftright(row_hash, 33) + (1 << 30)) * F.col("_part.pieces"), 31).cast("int")
    return out.withColumn("part", F.col("_part.part") + piece).drop("_part")


def with_parts(pages: DataFrame, part_rows: int, row_hash: Column) -> tuple[DataFrame, int]:
    """``pages`` with ``part``, and how many parts there are: numbers in the order of page_id of about ``part_rows`` rows each."""
    parts = plan_parts(pages, part_rows, F.lit(1))
    return in_parts(pages, parts, row_hash), parts.n


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 1000, roll_bytes: int | None = None, part_rows: int | None = None, part_bytes: int = 32 << 20) -> DataFrame:
    """Writes gzipped records in order of page_id and gives the manifest (file, records, bytes, sha1).

    ``pages`` has page_id, url, html. Of the pages with an equal payload of ``least_bytes`` at least, those of the largest page_id are
    responses and the others revisit it; rows with a null id refer to the others' largest id, if there is one. Payloads are
    counted by digest, first by part, and a part's task gets the digests that repeat ahead of its rows, so html moves once.

    Rows are range-sorted into parts of about ``part_bytes`` of records (or ``part_rows`` rows) that depend on ids and sizes alone. A part is a task, which starts a new file as
    soon as one has ``roll_bytes`` compressed bytes (by default a quarter of a part); only a part's last file is smaller. Parts, and so files, grow with a table of more than ``MOST_PARTS`` parts.
    A file gets its name only when whole: a repeated task
    writes the same bytes again, and so does another run, however the input is dealt. The manifest, itself committed as a table, lists the files that count.
    """
    row_hash = F.xxhash64("url", "html")
    pages = pages.select("page_id", "url", "html")
    # sizes, digests and hashes once, without the html
    digest = F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary")))
    brief = stored(pages.select("page_id", (F.coalesce(F.octet_length("html"), F.lit(0)) + HEAD_BYTES).cast("long").alias("w"), digest.alias("digest"), row_hash.alias("h")), "pages")
    parts = plan_parts(brief, part_rows, F.lit(1)) if part_rows else plan_parts(brief, part_bytes, F.col("w"))
    if roll_bytes is None:
        roll_bytes = (64 << 20) if part_rows else parts.size // 4
    digests = stored(in_parts(brief.where("digest is not null"), parts, F.col("h")).groupBy("part", "digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")), "digests")
    repeated = digests.groupBy("digest").agg(F.max("keep").alias("keep"), F.sum("n").alias("n")).where("n > 1 and keep is not null").select("digest", "keep")
    ahead = digests.select("part", "digest").join(repeated, "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        temp = f"{path}/_part.{TaskContext.get().taskAttemptId()}"
        rows, out, size, n, whole, at, seq, known = [], None, 0, 0, hashlib.sha1(), None, 0, {}

        def close() -> None:
            out.close()
            name = f"pages-{at:06d}-{seq:04d}.warc.gz"
            files.move(temp, f"{path}/{name}")
            rows.append({"file": name, "records": n, "bytes": size, "sha1": whole.hexdigest()})

        for batch in batches:
            for part, digest, keep, page_id, url, html in zip(*(batch.column(k) for k in range(6)), strict=True):
                part, digest, page_id = part.as_py(), digest.as_py(), page_id.as_py()
                if part != at:
                    if out is not None:
                        close()
                    out, at, seq, known = None, part, 0, {}
                if digest is not None:
                    known[digest] = keep.as_py()
                    continue
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                refers_to = known.get(hashlib.sha1(payload).hexdigest()) if len(payload) >= least_bytes else None
                if refers_to is not None and page_id is not None and page_id >= refers_to:
                    refers_to = None
                if out is None:
                    out, size, n, whole = files.open_output_stream(temp), 0, 0, hashlib.sha1()
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page_id, url.as_py(), payload, refers_to)) + squeeze.flush()
                out.write(data)
                whole.update(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    close()
                    out, seq = None, seq + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    none = F.lit(None)
    rows = in_parts(pages, parts, row_hash).select("part", none.cast("string").alias("digest"), none.cast("long").alias("keep"), "page_id", "url", "html", row_hash.alias("h"))
    rows = rows.unionByName(ahead, allowMissingColumns=True).repartitionById(parts.n, "part")
    rows = rows.sortWithinPartitions("part", F.col("digest").desc_nulls_last(), F.col("page_id").asc_nulls_first(), "h", "url", "html").drop("h")
    rows.mapInArrow(run, "file string, records long, bytes long, sha1 string").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_warc(manifest: DataFrame, folder: str, piece: int = 1 << 20) -> DataFrame:
    """One row for each record of the files that ``manifest`` names, one record in memory at a time."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(folder)
                rows, out, left = [], [], zlib.decompressobj(31)
                with files.open_input_file(f"{path}/{name}") as f:
                    data = f.read(piece)
                    while data:
                        out.append(left.decompress(data))
                        data = left.unused_data
                        if left.eof:
                            rows.append(parse(b"".join(out)))
                            out, left = [], zlib.decompressobj(31)
                            if len(rows) >= 1000:
                                yield pa.RecordBatch.from_pylist(rows, kinds)
                                rows = []
                        data = data or f.read(piece)
                if out and any(out):
                    raise ValueError(f"cut off: {name}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return manifest.select("file").repartition(parts, "file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def warc_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Writes a record for each page and gives what reading the archives back finds.

    Columns page_id, payload_bytes, payload_digest (hex SHA-1 of the whole payload), record_type,
    refers_to, url. A null html is an empty payload; a null url has no header; a line break in a url
    is percent-encoded; repeated rows each have a record; an empty table gives no rows.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read_warc(write_warc(chosen, folder, least_bytes), folder)
