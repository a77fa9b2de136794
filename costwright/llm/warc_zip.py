"""WARC records in ZIP packages, read by ranges.

A package is a ZIP file of stored members: `archive/data.warc.gz`, whose records are gzip
members of their own, and `indexes/index.cdxj`, which names each record's offset and length.
The reader takes any source that can return a range of bytes. It parses the end of central directory
record, the ZIP64 one where a field overflows, the central directory and a member's local
header, and then reads index and records in place; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwright.llm.shared import written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed once its records reach this size; a longer record gets one of its own.
PACKAGE_BYTES = 8 << 20
#: Records carry this date, as pages have none.
CRAWL_DATE = "2000-01-01T00:00:00Z"

# Signatures and field layouts of the ZIP format.
_END, _END64_LOCATOR, _END64 = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
_CENTRAL, _LOCAL = b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

# What the WARC standard calls this kind of revisit.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Source(Protocol):
    """Bytes that can be read by range."""

    size: int

    def read(self, start: int, length: int) -> bytes: ...


class BytesSource:
    """A package held in memory, such as a binary column's value."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = memoryview(data), len(data)

    def read(self, start: int, length: int) -> bytes:
        return bytes(self.data[start : start + length])


class FileSource:
    """A seekable file."""

    def __init__(self, file: io.BufferedIOBase) -> None:
        self.file = file
        self.size = file.seek(0, io.SEEK_END)

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipPackage:
    """The central directory of a ZIP file and range reads in its stored members."""

    def __init__(self, source: Source) -> None:
        self.source = source
        count, size, start = self._directory()
        self.members = {m.name: m for m in self._entries(source.read(start, size), count)}
        self._starts: dict[str, int] = {}

    def _directory(self) -> tuple[int, int, int]:
        """Number of entries, size and start of the central directory."""
        tail_at = max(0, self.source.size - 22 - _FULL16)
        tail = self.source.read(tail_at, self.source.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)  # a comment may hold the signature
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if count != _FULL16 and _FULL32 not in (size, start):
            return count, size, start
        locator = self.source.read(tail_at + at - 20, 20)
        if locator[:4] != _END64_LOCATOR:
            return count, size, start
        record = self.source.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        return struct.unpack_from("<QQQ", record, 32)

    @staticmethod
    def _entries(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name]
            extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
            while extra + 4 <= end:
                kind, length = struct.unpack_from("<HH", data, extra)
                if kind == 1:  # ZIP64: the fields that overflow, in this order
                    field = extra + 4
                    for which in ("size", "packed", "header"):
                        if {"size": size, "packed": packed, "header": header}[which] == _FULL32:
                            value = struct.unpack_from("<Q", data, field)[0]
                            field += 8
                            size = value if which == "size" else size
                            packed = value if which == "packed" else packed
                            header = value if which == "header" else header
                extra += 4 + length
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, header)
            at = end + n_comment

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        if name not in self._starts:
            local = self.source.read(member.header, 30)
            if local[:4] != _LOCAL:
                raise ValueError("broken local header")
            self._starts[name] = member.header + 30 + sum(struct.unpack_from("<HH", local, 26))
        length = member.size - start if length is None else min(length, member.size - start)
        return self.source.read(self._starts[name] + start, length)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the record refers_to, which keeps the HTTP headers only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {CRAWL_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.insert(3, f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _fields(http), payload)


def write_package(records: list[tuple[str | None, str, bytes]]) -> bytes:
    """A package of (url, digest, record bytes)."""
    data, lines = io.BytesIO(), []
    for url, digest, record in records:
        start, pack = data.tell(), zlib.compressobj(1, zlib.DEFLATED, 31)
        data.write(pack.compress(record) + pack.flush())
        place = {"url": url, "digest": digest, "offset": start, "length": data.tell() - start, "filename": DATA}
        lines.append(f"{url or '-'} {re.sub('[^0-9]', '', CRAWL_DATE)} {json.dumps(place)}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        package.writestr(DATA, data.getbuffer())
        package.writestr(INDEX, "\n".join(sorted(x.replace("\n", "%0A") for x in lines)))
    return out.getvalue()


def read_package(source: Source) -> Iterator[Record]:
    """The records that the package's index lists, in the order of their place in the archive."""
    package = ZipPackage(source)
    places = [json.loads(x[x.index(" {") + 1 :]) for x in package.read(INDEX).decode().split("\n") if x]
    for place in sorted(places, key=lambda p: p["offset"]):
        yield parse_record(zlib.decompress(package.read(place["filename"], place["offset"], place["length"]), 31))


def write_archives(pages: DataFrame, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages (name, package) with a record for each row of page_id, url, html; other columns are not read.

    Of equal payloads of at least least_bytes the one with the largest page_id is the response
    and the others revisit it; rows that share that page_id are all responses, and so are
    those of a payload whose ids are all null. A null html is an empty payload. An
    empty table gives no package. Equal payloads meet as digests and largest ids only
    before they are joined to the pages, and the join has no side that grows with a group.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    largest = (
        rows.filter(F.length("payload") >= least_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    rows = rows.join(largest, "sha1", "left").select(
        "page_id", "url", "payload", F.expr("if(page_id <=> kept, null, kept)").alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, str, bytes]] = []
        size = 0

        def package() -> pa.RecordBatch:
            data = write_package(held)
            name = f"{hashlib.sha256(data).hexdigest()[:32]}.wacz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "package"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base32_sha1(payload)
                target = None if refers_to is None else f"urn:page:{refers_to}"
                record = record_bytes(f"urn:page:{'' if page_id is None else page_id}", url, payload, digest, target)
                held.append((url, digest, record))
                size += len(record)
                if size >= package_bytes:
                    yield package()
                    held, size = [], 0
        if held:
            yield package()

    return rows.mapInArrow(run, "name string, package binary")


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix("urn:page:")
    return int(text) if text else None


def read_archives(packages: DataFrame) -> DataFrame:
    """A row per record of packages as written: page_id, url, type, digest, length of payload, refers_to, payload.

    A response's payload is checked against its digest. A revisit has no payload (null).
    """
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0):
                rows = []
                for record in read_package(BytesSource(package.as_py())):
                    h = record.headers
                    digest, response = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "response"
                    if response and base32_sha1(record.payload) != digest:
                        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                    rows.append((
                        _page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], digest,
                        int(record.http["content-length"]), _page(h.get("warc-refers-to")),
                        record.payload if response else None,
                    ))
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return packages.select("package").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the packages to the shared folder and reads the records back from there."""
    return read_archives(written(write_archives(pages, least_bytes), "archives"))
