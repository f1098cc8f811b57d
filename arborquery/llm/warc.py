"""WARC records in ZIP packages: written from pages, found again through directories, read by ranges.

A package is a ZIP archive whose members are stored, not compressed: archive/data.warc.gz, each record a gzip member
of its own, and indexes/index.cdx, one line of JSON a record with its offset and length. The reader takes the end of
the central directory (the ZIP64 one too), the directory, then the local header of a stored member, and reads records
by range from wherever the bytes are: it never extracts a member.

Packages are rows of a table in the folder all executors share, since only Spark can write everywhere it reads; any
object with read_at(offset, size) and a size can be read, files too.

Defined cases: a null or empty page is a response of no bytes, and pages of equal payloads of at least LEAST bytes are
revisits of the smallest page_id among them; rows that repeat a page_id are records each, of which the one response
is any; a null page_id cannot be named and is left out of the choice of the response; an empty table gives an empty
result; whole pages are written, however long; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, written

#: Payloads smaller than this are always responses.
LEAST = 0
#: Bytes of records in a package: a package is closed by the record that reaches them.
PACKAGE_BYTES = 4 << 20
#: Rows of the list of revisits, of 36 bytes each, that are sent to all executors at most.
SENT = 200_000
#: Fixed value: the date of written records, so that equal pages give equal bytes.
DATE = "2024-01-01T00:00:00Z"

# Signatures of the ZIP format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


class Source(Protocol):
    size: int

    def read_at(self, offset: int, size: int) -> bytes: ...


class Buffer:
    """Bytes held in memory, or a part of a file mapped there."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.size = memoryview(data), len(data)

    def read_at(self, offset: int, size: int) -> bytes:
        if offset < 0 or offset + size > self.size:
            raise ValueError(f"range {offset}+{size} is outside {self.size} bytes")
        return bytes(self.data[offset : offset + size])


class File:
    """A local file."""

    def __init__(self, path: str):
        import os

        self.path, self.size = path, os.path.getsize(path)

    def read_at(self, offset: int, size: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return f.read(size)


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def members(source: Source) -> dict[str, Member]:
    """The central directory, by name."""
    tail_at = max(0, source.size - 65557)
    tail = source.read_at(tail_at, source.size - tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    if at < 0 or at + 22 > len(tail):
        raise ValueError("no end of a central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = source.read_at(tail_at + at - 20, 20)
        signature, _, end64, _ = struct.unpack("<IIQI", locator)
        if signature != _LOCATOR:
            raise ValueError("no locator of a ZIP64 directory")
        record = source.read_at(end64, 56)
        if struct.unpack_from("<I", record)[0] != _END64:
            raise ValueError("no end of a ZIP64 directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory = source.read_at(start, size)
    found, at = {}, 0
    for _ in range(count):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if head[0] != _CENTRAL:
            raise ValueError("a broken central directory")
        method, packed, plain, name_len, extra_len, comment_len, header = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
        name = directory[at + 46 : at + 46 + name_len]
        extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # the values that did not fit, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            e += 4 + n
        key = name.decode("utf-8" if head[3] & 0x800 else "cp437")
        found[key] = Member(key, method, packed, header)
        at += 46 + name_len + extra_len + comment_len
    return found


def stored_at(source: Source, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: its records cannot be read by range")
    head = source.read_at(member.header, 30)
    if struct.unpack_from("<I", head)[0] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    name_len, extra_len = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_len + extra_len


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes


def parse_record(data: bytes) -> Record:
    """One WARC record: its headers in lower case, and its payload without HTTP headers."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(headers["content-length"])]
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return Record(headers, block)


def records(source: Source) -> Iterator[tuple[dict, Record]]:
    """(index entry, record) of every line of the indexes, each read by its range."""
    directory = members(source)
    starts: dict[str, int] = {}
    for name in sorted(directory):
        if not name.startswith("indexes/"):
            continue
        member = directory[name]
        for line in source.read_at(stored_at(source, member), member.size).decode().splitlines():
            entry = json.loads(line[line.index("{") :])
            target = f"archive/{entry['filename']}"
            if target not in starts:
                starts[target] = stored_at(source, directory[target])
            data = source.read_at(starts[target] + int(entry["offset"]), int(entry["length"]))
            yield entry, parse_record(zlib.decompress(data, 31) if target.endswith(".gz") else data)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of another page's response, uncompressed."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A package in the making."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.lines: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packer.compress(make_record(page_id, url, payload, refers_to)) + packer.flush()
        entry = {"url": url, "mime": "text/html" if refers_to is None else "warc/revisit", "digest": digest(payload), "filename": DATA.partition("/")[2], "offset": self.size, "length": len(data)}
        self.lines.append(f"{page_id or 0:020d} {DATE} {json.dumps(entry)}")
        self.parts.append(data)
        self.size += len(data)

    def build(self, zip64: bool = False) -> bytes:
        """The archive; zip64: with ZIP64 fields whatever its size (always beyond 4 GB)."""
        out, directory, at = [], [], 0
        for name, content in ((DATA, b"".join(self.parts)), (INDEX, "\n".join(sorted(self.lines)).encode())):
            raw, crc, n = name.encode(), zlib.crc32(content), len(content)
            wide = zip64 or max(n, at) >= 0xFFFFFFFF
            size = 0xFFFFFFFF if wide else n
            extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
            local = struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, size, size, len(raw), len(extra)) + raw + extra
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
            directory.append(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + extra)
            out += [local, content]
            at += len(local) + n
        listing = b"".join(directory)
        out.append(listing)
        wide = zip64 or at >= 0xFFFFFFFF
        if wide:
            out.append(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, 2, 2, len(listing), at))
            out.append(struct.pack("<IIQI", _LOCATOR, 0, at + len(listing), 1))
        out.append(struct.pack("<IHHHHIIH", _END, 0, 0, 0xFFFF if wide else 2, 0xFFFF if wide else 2, 0xFFFFFFFF if wide else len(listing), 0xFFFFFFFF if wide else at, 0))
        return b"".join(out)


def pages_of(pages: DataFrame) -> DataFrame:
    """page_id, url and html as binary; nulls of the latter two as empty."""
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    return pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), html.alias("html"))


def with_responses(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The pages with refers_to: the smallest page_id of an equal payload, if that is another page's.

    Revisits are found among ids and digests alone. What joins the whole pages is the list of revisits: it is counted, and
    sent to the pages where it has SENT rows at most, so that none moves.
    """
    pages = pages_of(pages)
    marked = pages.withColumn("sum", F.unhex(F.sha1("html")))
    marks = pages.filter(F.octet_length("html") >= least).select("page_id", F.unhex(F.sha1("html")).alias("sum"))
    marks = written(marks, "warc-sums")  # 28 bytes a page, read twice
    first = marks.groupBy("sum").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = written(marks.join(first, "sum").filter(F.col("refers_to") < F.col("page_id")).distinct(), "warc-revisits")
    revisits = F.broadcast(revisits) if revisits.count() <= SENT else revisits
    return marked.join(revisits, ["page_id", "sum"], "left").select("page_id", "url", "html", "refers_to")


def packed(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages of bounded size: (package, n_records, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = Package()

        def close() -> pa.RecordBatch:
            row = [pa.array([x], t) for x, t in ((uuid.uuid4().hex, pa.string()), (len(package.parts), pa.int64()), (package.build(), pa.binary()))]
            return pa.RecordBatch.from_arrays(row, ["package", "n_records", "data"])

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                package.add(page_id, url, html, refers)
                if package.size >= package_bytes:
                    yield close()
                    package = Package()
        if package.parts:
            yield close()

    return map_arrow(pages, run, "package string, n_records long, data binary")


def read_back(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, package, record_offset) of every record, as the archives have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for entry, record in records(Buffer(data.as_buffer())):
                    h = record.headers
                    revisit = h["warc-type"] == "revisit"
                    n, sum_ = (int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")) if revisit else (len(record.payload), digest(record.payload))
                    rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, n, sum_, h["warc-type"], int(h["x-refers-to-page"]) if revisit else None, name, int(entry["offset"])))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "package", "record_offset"])

    return map_arrow(packages.select("package", "data"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, package string, record_offset long")


def archived(pages: DataFrame) -> DataFrame:
    """The pages written as packages into the shared folder: the table of packages."""
    return written(packed(with_responses(pages)), "warc-packages")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back."""
    return read_back(archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the pages alone. DuckDB's sha1 gives hexadecimal digits, so base32 digits are cut from 40-bit parts.
SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p
)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, 1 + (i // 8) * 10, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < page_id THEN least END AS refers_to
FROM d
"""
