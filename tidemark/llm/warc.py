"""WARC archives: writing with revisit records for repeated payloads, and a reader that salvages damaged archives.

Archives are written by Spark's text writer, so they can go to any store and a lost task leaves nothing half-written. The
records of plain archives begin with a version line; archives of others may also be a run of gzip members. When
a record or a member fails a check (its framing, its length, its payload digest), the reader searches for the next member
or version line at which a whole valid record stands, recovers from there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored

#: Payloads below this many bytes are always written out.
LEAST_REVISIT = 100
#: Records of at most so many bytes go so many to a file, so that a file has 128 MB or one record; a reader's task holds one file.
FILES = ((1 << 16, 2000), (1 << 20, 128), (1 << 24, 8), (1 << 31, 1))
#: Revisits up to this many are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_REVISITS = 200_000
DATE = "2024-01-01T00:00:00Z"

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_ID = re.compile(r"<urn:page:(-?\d+)>")


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("") for name, value in fields))


def records(pages: DataFrame) -> DataFrame:
    """value: one WARC record, without its last line break, per row of pages (page_id, url, html); bytes: of its payload."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = plain.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html"))
    large = hashed.filter(F.col("bytes") >= LEAST_REVISIT).select("page_id", "digest")
    repeated = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    revisits = stored(large.join(repeated, "digest").filter("page_id > first").select("page_id", "digest", "first").distinct())
    known = F.broadcast(revisits) if revisits.count() <= BROADCAST_REVISITS else revisits
    all_ = hashed.join(known, ["page_id", "digest"], "left")

    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", urn(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return all_.select(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block, F.lit("\r\n")).alias("value"), "bytes")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as WARC archives, of a bounded size unless a single record is larger."""
    made = records(pages)
    length = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    sizes = [F.when(length <= most, k) for k, (most, _) in enumerate(FILES)]
    present = sorted(r.size for r in pages.select(F.coalesce(*sizes).alias("size")).distinct().collect())
    for k in present or [0]:
        least, most = (FILES[k - 1][0] if k else -1), FILES[k][0]
        part = made if len(present) < 2 else made.filter((F.col("bytes") > least) & (F.col("bytes") <= most))
        part.select("value").write.mode("append").option("lineSep", "\r\n").option("maxRecordsPerFile", FILES[k][1]).text(path)


def _agrees(data: bytes, digest: str) -> bool:
    """Whether a digest such as sha1:... (base32 or hex) is that of the data; unknown kinds are taken on trust."""
    kind, _, value = digest.partition(":")
    if kind.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        return True
    made = hashlib.new(kind.lower().replace("-", ""), data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    gap: str | None = None  # why these bytes were quarantined


def _plain(data: bytes, at: int) -> Record | str:
    """The record at a version line, or what is wrong with it."""
    if not _VERSION.match(data, at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "header without end"
    headers = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return "header line without a colon"
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        return "no content length"
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "content length doesn't end at a record's end"
    record = Record(at, end + 4 - at, headers, data[stop + 4 : end])
    if not _agrees(record.block, headers.get("warc-block-digest", "")):
        return "block digest doesn't match"
    if headers.get("warc-type") == "response" and not _agrees(payload(record), headers.get("warc-payload-digest", "")):
        return "payload digest doesn't match"
    return record


def _member(data: bytes, at: int) -> tuple[int, list[Record]] | str:
    """The end of the gzip member at `at` and the records in it, or what is wrong with it."""
    inflate, out, read = zlib.decompressobj(wbits=31), bytearray(), at
    try:
        while not inflate.eof and read < len(data):
            out += inflate.decompress(data[read : read + (1 << 16)])
            read += 1 << 16
    except zlib.error as error:
        return f"gzip: {error}"
    if not inflate.eof:
        return "gzip member without end"
    end = min(read, len(data)) - len(inflate.unused_data)
    found = list(read_archive(bytes(out)))
    if not found or any(r.gap for r in found):
        return next((r.gap for r in found if r.gap), "empty gzip member")
    for record in found:
        record.offset, record.length = at, end - at
    return end, found


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive in order, and the gaps between them that no valid record covers."""
    at, gap, why = 0, None, ""
    while at < len(data):
        found = _member(data, at) if data.startswith(_MAGIC, at) else _plain(data, at)
        if isinstance(found, str):
            if gap is None:
                gap, why = at, found
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield Record(gap, at - gap, gap=why)
            gap = None
        end, records_ = (at + found.length, [found]) if isinstance(found, Record) else found
        yield from records_
        at = end
    if gap is not None:
        yield Record(gap, len(data) - gap, gap=why)


def payload(record: Record) -> bytes:
    """The block behind the HTTP headers."""
    return record.block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    found = _ID.fullmatch(urn or "")
    return int(found[1]) if found else None


def _http_length(record: Record) -> int | None:
    found = re.search(rb"(?im)^content-length:\s*(\d+)", record.block.partition(b"\r\n\r\n")[0])
    return int(found[1]) if found else None


COLUMNS = "file string, offset long, length long, gap string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for r in read_archive(content.as_py()):
                    h = r.headers
                    rows.append(
                        {
                            "file": name.as_py(), "offset": r.offset, "length": r.length, "gap": r.gap, "page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"),
                            "payload_bytes": None if r.gap else _http_length(r), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                            "record_type": h.get("warc-type"), "refers_to": _page(h.get("warc-refers-to")),
                        } | ({"payload": payload(r)} if with_payload else {})
                    )
                names = [c.split()[0] for c in COLUMNS.split(", ")] + ["payload"] * with_payload
                kinds = {"string": pa.string(), "long": pa.int64()}
                types = [kinds[c.split()[1]] for c in COLUMNS.split(", ")] + [pa.binary()] * with_payload
                yield pa.RecordBatch.from_arrays([pa.array([row[n] for row in rows], t) for n, t in zip(names, types, strict=True)], names)

    return run


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps (gap: the reason, other columns null) of all archives in a folder; one row each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), COLUMNS + ", payload binary" * with_payload)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read their records back.

    pages: page_id long, url, html (more columns are ignored). Returns per row: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A null html is an empty payload; a null url has no target line. Rows without an id are responses and come back
    without one. Of repeated rows, all that have the smallest page_id of their payload are responses. A payload may have up to
    2 GB, which is what Spark's reader takes in one file. An empty table gives an empty result. A gap in what was read
    back, which a damaged file in the shared folder would leave, ends the query with the gap's file, place and reason;
    read_archives returns gaps as rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    told = F.concat_ws(" ", F.lit("quarantined:"), "file", F.col("offset").cast("string"), F.col("length").cast("string"), "gap")
    number = F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(F.raise_error(told).cast("long"))
    return read_archives(spark, path).select(number.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
