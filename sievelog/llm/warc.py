"""WARC archives with an index: written first, read back by coalesced byte ranges.

Each record is its own gzip member, as usual for ``.warc.gz``.  Writing gives
an index row per record (file, offset, length, url, digest); reading sorts the
selected index rows by file and offset and joins near ranges into one read.
Archives lie in the folder that driver and executors share and are reached
through ``pyarrow.fs`` (local, HDFS, S3, GCS).  A task writes to files with
names of their own, so a task that runs again leaves an unused file at most:
the index, kept as a checkpoint, names only files of finished tasks.

Defined cases: null html is an empty payload; a null url is written as empty;
white space and control characters in a url are percent-encoded; an empty
table gives no archive and an empty result; other columns are ignored; rows
that repeat a page_id are records of their own, of which one is the response if
their payloads are equal; a row with a null page_id is a response unless an
equal payload has an id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ORD, checkpoint, new_folder, with_order

INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
BASE16, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: An archive is closed after so many compressed bytes.
ROLL = 512 << 20
#: Ranges this near are read as one, up to so many bytes.
GAP, SPAN = 64 << 10, 8 << 20
#: Compressed bytes that a reading task gets.
TASK = 16 << 20


def sha1_base32(column: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(F.encode(column, "UTF-8"))
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), BASE16, BASE32)


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record(page_id, url, rep, digest: str, payload: bytes, date: str) -> tuple[str, bytes]:
    kind = "response" if rep is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if rep is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if rep is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{rep}>",
        ]
    return kind, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _writer(folder: str, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None:
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (row["html"] or "").encode()
                    kind, record = _record(row["page_id"], row["url"], row["rep"], row["digest"], payload, date)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = packer.compress(record) + packer.flush()
                    out.write(packed)
                    rows.append((row["page_id"], row["url"], kind, row["rep"], len(payload), row["digest"], name, offset, len(packed)))
                    offset += len(packed)
                    if offset >= ROLL:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 9, _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return write


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]


def write_warc(
    pages: DataFrame, folder: str | None = None, *, least: int = 0, date: str = "2020-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> tuple[str, DataFrame]:
    """Write all pages; returns the folder and the index, a row per record.

    Of records with equal payloads of at least ``least`` bytes the one with
    the smallest id is the response and the others revisit it.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    base, _ = with_order(pages, id_col, F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = base.withColumn("digest", sha1_base32(html)).withColumn("size", F.octet_length(html))
    first = (
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min(F.struct(ORD, "page_id")).alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first.page_id IS NOT NULL")
        .select("digest", F.col("first.page_id").alias("rep"), F.col(f"first.{ORD}").alias("rep_ord"))
    )
    # the small side is a checkpoint, so that the join deals both sides itself and Spark can split a page that many urls return
    found = rows.join(checkpoint(first), "digest", "left")
    again = (F.col("size") >= least) & (F.col(ORD) != F.col("rep_ord"))
    found = found.select("page_id", "url", "html", "digest", F.when(again, F.col("rep")).alias("rep"))
    return folder, checkpoint(found.mapInArrow(_writer(folder, date), INDEX))


def read_ranges(fs: pafs.FileSystem, root: str, wanted: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """Bytes of each (file, offset, length), which come sorted; near ranges are one read."""
    at = 0
    while at < len(wanted):
        name, begin, length = wanted[at]
        end, to = begin + length, at + 1
        while to < len(wanted) and wanted[to][0] == name and wanted[to][1] - end <= GAP and wanted[to][1] + wanted[to][2] - begin <= SPAN:
            end = max(end, wanted[to][1] + wanted[to][2])
            to += 1
        with fs.open_input_file(f"{root}/{name}") as file:
            block = file.read_at(end - begin, begin)
        for _, offset, size in wanted[at:to]:
            yield block[offset - begin : offset - begin + size]
        at = to


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one gzip member."""
    record = zlib.decompress(packed, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]
        for batch in batches:
            rows, size = [], 0
            wanted = list(zip(*(batch.column(x).to_pylist() for x in ("file", "offset", "length")), strict=True))
            for packed in read_ranges(fs, root, wanted):
                headers, block = parse_record(packed)
                http, _, payload = block.partition(b"\r\n\r\n")
                number = lambda key: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", headers.get(key, ""))) else None  # noqa: B023, E731
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"record {headers['warc-record-id']} is damaged")
                rows.append((number("warc-record-id"), headers["warc-target-uri"], kind, number("warc-refers-to"), length, digest, payload if kind == "response" else None))
                size += len(payload)
                if size > SPAN:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return read


def read_warc(folder: str, index: DataFrame, *, task_bytes: int = TASK) -> DataFrame:
    """Records of the selected index rows, digests verified; a revisit has no payload of its own.

    ``index`` is read twice: its lengths say how many tasks the reading takes.
    """
    places = index.select("file", "offset", "length")
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ordered = places.repartitionByRange(max(1, -(-size // task_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(folder), RECORDS)
