"""Web archives packed in ZIP files: writer, ZIP and ZIP64 directory reader, range reads.

An archive holds ``archive/data.warc.gz`` (a gzip member per record) and
``indexes/index.cdxj`` (a JSON line per record with its place), both stored uncompressed,
so that a record is one byte range of the ZIP file and nothing is unpacked.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poi_analytics.llm.shared import NO_ID, ordered_id, saved, scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ReadAt = Callable[[int, int], bytes]  # (offset, length) -> bytes


# --- ZIP directories ---------------------------------------------------------------------------

# Signatures and field widths fixed by the ZIP format.
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
CENTRAL, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
LONGEST_COMMENT = 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int  # bytes in the archive
    header: int  # offset of the local header


class ZipDirectory:
    """The members of a ZIP file, read through byte ranges only."""

    def __init__(self, read_at: ReadAt, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 22 - LONGEST_COMMENT)
        tail = read_at(tail_at, size - tail_at)
        at = len(tail)
        while True:  # the last signature whose comment reaches exactly to the end
            at = tail.rfind(END, 0, at)
            if at < 0:
                raise ValueError("not a ZIP file: no end of central directory")
            if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if FULL16 == count or FULL32 in (length, start):
            locator = read_at(end - 20, 20) if end >= 20 else b""
            if locator[:4] == LOCATOR64:
                record_at = struct.unpack_from("<Q", locator, 8)[0]
                record = read_at(record_at, 56)
                if record[:4] != END64:
                    raise ValueError("damaged ZIP64 end of central directory")
                count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._central(read_at(start, length), count)}

    @staticmethod
    def _central(directory: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if directory[at:at + 4] != CENTRAL:
                raise ValueError("damaged ZIP central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            stored, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that are full above, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(wide) if size == FULL32 else size
                    stored = next(wide) if stored == FULL32 else stored
                    header = next(wide) if header == FULL32 else header
                extra = extra[4 + n:]
            yield Member(name, method, size, stored, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, member: Member) -> int:
        """Offset of a member's first byte; only stored members can be read by range."""
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{member.name} is compressed; range reads need a stored member")
        local = self.read_at(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"damaged local header of {member.name}")
        return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))

    def read(self, member: Member) -> bytes:
        return self.read_at(self.start(member), member.stored)


# --- WARC records ------------------------------------------------------------------------------

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(fields: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode()


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member.  A revisit keeps the HTTP headers, not the payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_urn(page_id)),
              ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)),
              ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))]
    if revisit:
        fields += [("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return gzip.compress(b"WARC/1.1\r\n" + _headers(fields) + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _split_headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}, rest


def parse_record(member: bytes) -> dict:
    """The fields and payload of a gzipped record; a payload that fails its digest is an error."""
    fields, rest = _split_headers(gzip.decompress(member))
    block = rest[:int(fields["content-length"])]
    http, payload = _split_headers(block)
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")

    def page(urn: str) -> int | None:
        number = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""),
            "payload_bytes": int(http["content-length"]) if revisit else len(payload), "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": page(fields["warc-refers-to"]) if revisit else None,
            "payload": None if revisit else payload}


# --- archives ----------------------------------------------------------------------------------

class ArchiveWriter:
    """Streams records into one ZIP file; only the index lines of the open archive are in memory."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page_id: int | None, url: str | None, record: bytes) -> None:
        self.data.write(record)
        self.lines.append(json.dumps({"page_id": page_id, "url": url, "offset": self.size, "length": len(record)}))
        self.size += len(record)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()


def record_ranges(directory: ZipDirectory) -> Iterator[tuple[int, int]]:
    """(offset in the ZIP file, length) of every record, from the index or else by walking the members."""
    members = directory.members
    start = directory.start(members[DATA])
    if INDEX in members:
        for line in directory.read(members[INDEX]).decode().splitlines():
            entry = json.loads(line)
            yield start + entry["offset"], entry["length"]
        return
    at, end, step = start, start + members[DATA].stored, 1 << 16
    while at < end:
        gunzip, used = zlib.decompressobj(31), 0
        while not gunzip.eof:
            got = directory.read_at(at + used, min(step, end - at - used))
            if not got:
                raise ValueError("a record is cut off")
            gunzip.decompress(got)
            used += len(got) - len(gunzip.unused_data)
        yield at, used
        at += used


def read_archive(read_at: ReadAt, size: int) -> Iterator[dict]:
    for offset, length in record_ranges(ZipDirectory(read_at, size)):
        yield parse_record(read_at(offset, length))


def plan_revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to`` and ``revisit``.

    Of the rows with an equal payload of ``at_least`` bytes or more, those with the smallest
    page_id are responses and the others revisit them.  A hot payload is one row of the
    grouped minimum, and only digests that occur more than once join back.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.concat(F.sha1("html"), F.lit(":"), F.octet_length("html")))
    first = (rows.where(F.octet_length("html") >= at_least).select("digest", ordered_id("page_id").alias("id"))
             .groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
             .where("first < last").select(F.col("digest").alias("d"), "first"))
    first = saved(first, "repeats")  # of measured size: broadcast only if small
    joined = rows.join(first, rows.digest == first.d, "left")
    revisit = F.coalesce(ordered_id("page_id") > F.col("first"), F.lit(False))
    return joined.select("page_id", "url", "html",
                         F.when(revisit & (F.col("first") < NO_ID), F.col("first")).alias("refers_to"),
                         revisit.alias("revisit"))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of :func:`plan_revisits` as archives under ``folder``; returns their manifest.

    ``folder`` is a URI every executor reaches.  Names are unique per task attempt and only
    archives of finished attempts are in the manifest (path, bytes, records), so a repeated
    task leaves a stray file at worst, never a record twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        done, name, sink, writer = [], None, None, None

        def finish() -> None:
            writer.close()
            sink.close()
            done.append((name, store.get_file_info(name).size, len(writer.lines)))

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, html, refers_to, revisit = r
                if writer is None:
                    name = f"{path}/{uuid.uuid4().hex}.wacz"
                    sink = store.open_output_stream(name)
                    writer = ArchiveWriter(sink)
                writer.add(page_id, url, warc_record(page_id, url, html.encode("utf-8", "surrogatepass"),
                                                     refers_to, revisit))
                if writer.size >= archive_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], ["path", "bytes", "records"])

    return saved(planned.mapInArrow(run, "path string, bytes long, records long"), "manifest")


RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary, archive string")


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest``, range-read from ``folder``'s file system."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary()), ("archive", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for r in read_archive(lambda at, n, f=f: f.read_at(n, at), f.size()):
                        held += len(r["payload"] or b"")
                        rows.append(r | {"archive": path} | ({} if payloads else {"payload": None}))
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # an archive a task: a round-robin deal of the few manifest rows
    spread = manifest.select("path").repartition(max(spark.sparkContext.defaultParallelism * 4, 1))
    return spread.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, at_least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive every row of ``pages`` and read the records back (without the payloads).

    A null html is an empty payload, a null url an empty one; a null page_id counts as the largest
    id.  Rows that repeat the smallest page_id of a payload are all responses.  Other columns are
    ignored; an empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "archives")
    manifest = write_archives(plan_revisits(pages, at_least), folder, archive_bytes)
    return read_archives(spark, manifest, folder, payloads=False).drop("payload")
