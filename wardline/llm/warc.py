"""WARC records in ZIP packages: written, indexed, and read by byte ranges without extraction.

A package is a ZIP of stored (uncompressed) members, streamed in one pass: archive/data.warc.gz, one gzip member for each record,
and indexes/index.cdxj, one line for each record with its offset and length. The reader parses the end of
the central directory, the ZIP64 records where present, the central directory and the local headers, then
reads only the ranges it needs. Packages lie in the shared folder, reached through its file system, so the
driver and all executors see them; each is written under its own name and listed in a table only by the
task that finished it, so a lost task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StringType

from .common import byte_column, materialize, new_path, sliced

#: Bytes of records after which a package is closed. Records are streamed, so a package's size is not held in memory.
PACKAGE = 512 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

# ZIP records, by their signatures (fixed values of the format)
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP ---


class ZipWriter:
    """Stored members and ZIP64 records, in one pass."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        big = self.zip64 or len(data) >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = FULL32 if big else len(data)
        self._write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._write(data)
        self.entries.append([raw, crc, len(data), start, 0x800])

    def open(self, name: str) -> None:
        """Begins a member whose size is not known yet: it follows the data, in a descriptor."""
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if self.zip64 else b""
        size = FULL32 if self.zip64 else 0
        self.entries.append([raw, 0, 0, self.at, 0x808])
        self._write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if self.zip64 else 20, 0x808, 0, 0, 33, 0, size, size, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        """More of the member opened last."""
        entry = self.entries[-1]
        entry[1], entry[2] = zlib.crc32(data, entry[1]), entry[2] + len(data)
        self._write(data)

    def end(self) -> None:
        _, crc, size, *_ = self.entries[-1]
        self._write(struct.pack("<4sIQQ" if self.zip64 else "<4sIII", DESCRIPTOR, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset, flags in self.entries:
            big = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            s, o = (FULL32, FULL32) if big else (size, offset)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, flags, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n, end = self.at - start, len(self.entries), self.at
        if big := (self.zip64 or n >= FULL16 or start >= FULL32 or size >= FULL32):
            self._write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sIQI", LOCATOR, 0, end, 1))
        self._write(struct.pack("<4sHHHHIIH", END, 0, 0, *((FULL16,) * 2 if big else (n, n)), FULL32 if big else size, FULL32 if big else start, 0))


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    header: int
    start: int = -1


class ZipReader:
    """Members of a package by its directories. ``read_at(offset, length)`` is all it needs of a file."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        tail_at = max(0, size - 22 - FULL16)
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the signature can occur in a comment
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, n, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        if FULL16 == n or FULL32 in (length, start):
            loc = read_at(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
            if loc[:4] != LOCATOR:
                if FULL32 in (length, start):
                    raise ValueError("no ZIP64 locator")
            else:
                where = struct.unpack("<IQI", loc[4:])[1]
                record = read_at(where, 56)
                if record[:4] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                n, length, start = struct.unpack("<QQQ", record[32:56])
        self.members: dict[str, Member] = {}
        directory, at = read_at(start, length), 0
        for _ in range(n):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<HHHHHHIIIHHHHHII", directory, at + 4)
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                tag, size_of = struct.unpack_from("<HH", extra)
                if tag == 1:  # 64-bit values, in this order, of the fields that are full
                    values = iter(struct.unpack(f"<{size_of // 8}Q", extra[4 : 4 + size_of // 8 * 8]))
                    plain = next(values) if plain == FULL32 else plain
                    packed = next(values) if packed == FULL32 else packed
                    header = next(values) if header == FULL32 else header
                extra = extra[4 + size_of :]
            self.members[name] = Member(name, method, crc, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def range(self, name: str, offset: int, length: int) -> bytes:
        """Bytes of a stored member."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed: no ranges")
        if m.start < 0:
            local = self.read_at(m.header, 30)
            if local[:4] != LOCAL:
                raise ValueError("broken local header")
            m.start = m.header + 30 + sum(struct.unpack_from("<HH", local, 26))
        if offset < 0 or offset + length > m.size:
            raise ValueError("range outside the member")
        return self.read_at(m.start + offset, length)


# --- WARC ---


def urn(page_id) -> str:
    """A record's name: the id as text, escaped; rows without an id share one name that no id has."""
    return "<urn:page-without-id>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def id_of(name: str) -> str | None:
    return None if name == urn(None) else unquote(name.removeprefix("<urn:page:").removesuffix(">"))


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """A response, or a revisit whose block is the HTTP head only; its Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Target-URI: {''.join(url.split())}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload."""
    head, rest = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of another length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def revisits(keyed: DataFrame, least: int) -> DataFrame:
    """(id, digest, refers_to) of the records that revisit another, from a table (id, size, digest). Digests are grouped with
    a maximum that combines before the shuffle, and joined without payloads, so a payload that very many pages share
    only meets as numbers."""
    d = keyed.where(F.col("size") >= least).select("id", "digest")
    last = d.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("times")).where("times > 1").drop("times")
    return d.join(last, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write_packages(pages: DataFrame, folder: str, least: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Writes a record for each row; returns the table (package, records) of finished packages.

    Null payloads are empty and null urls empty. Ids are whole numbers or texts. Of equal payloads of at least ``least`` bytes
    the record with the largest id is the response; rows that repeat that id with the same payload are responses
    too. Rows without an id are responses. An id with several payloads takes part with each, and is a revisit only of
    a payload that a larger id has as well. Other columns are not read; an empty table gives no package.

    Payloads are hashed once for a written table of numbers, from which the revisits are told, and once as the key by
    which each row finds its own.
    """
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), payload.alias("payload"))
    digest = F.sha1(F.col("payload").cast("binary")).alias("digest")
    keyed = materialize(rows.select("id", F.octet_length("payload").alias("size"), digest), "payloads")
    rows = rows.select("id", "url", "payload", digest).join(revisits(keyed, least), ["id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name, out, z, index = "", None, None, []

        def close() -> pa.RecordBatch:
            z.end()
            z.add(INDEX, "".join(index).encode())
            z.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], ["package", "records"])

        for batch in sliced(batches, "payload"):
            for i, url, body, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_column(batch, "payload"), batch.column(3).to_pylist(), strict=True):
                if z is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = system.open_output_stream(f"{path}/{name}")
                    z, index = ZipWriter(out), []
                    z.open(DATA)
                packed = _gzip(record(i, url, body, refers))
                index.append(json.dumps({"offset": z.entries[-1][2], "length": len(packed), "url": url}) + "\n")
                z.write(packed)
                if z.entries[-1][2] >= PACKAGE:
                    yield close()
                    z = None
        if z is not None:
            yield close()

    return rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "package string, records bigint")


def read_packages(packages: DataFrame, folder: str, id_column: str = "page_id", kind: DataType | None = None) -> DataFrame:
    """One row for each record of the listed packages, read through the directories and index by ranges; ``kind`` is the type
    of the ids (whole numbers of 64 bits where it isn't given)."""
    kind = kind or LongType()
    schema = f"{id_column} {kind.simpleString()}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind.simpleString()}"
    arrow, text = to_arrow_type(kind), isinstance(kind, StringType)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow, pa.int64(), pa.string(), pa.string(), arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [id_column, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        value = lambda name: x if (x := id_of(name)) is None or text else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as f:
                    z = ZipReader(lambda offset, length: f.read_at(length, offset), f.size())
                    rows = []
                    for line in z.range(INDEX, 0, z.members[INDEX].size).splitlines():
                        at = json.loads(line)
                        headers, http, payload = parse_record(zlib.decompress(z.range(DATA, at["offset"], at["length"]), 31))
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        if headers["warc-type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
                            raise ValueError(f"{name}: a payload is not what its record says")
                        rows.append((value(headers["warc-record-id"]), size, digest, headers["warc-type"], value(headers["warc-refers-to"]) if "warc-refers-to" in headers else None))
                        if len(rows) >= 10_000:
                            yield rows_of(rows)
                            rows = []
                    if rows:
                        yield rows_of(rows)

    return packages.select("package").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Writes the packages into the shared folder, then reads every record back."""
    folder = new_path(pages.sparkSession, "packages")
    done = materialize(write_packages(pages, folder, least, id_column, url_column, payload_column), "package-list")
    return read_packages(done.repartition(max(1, pages.sparkSession.sparkContext.defaultParallelism)), folder, id_column, pages.schema[id_column].dataType)
