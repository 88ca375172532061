"""WARC records in ZIP-packaged archives: a writer, and a reader that takes no archive apart.

An archive is a ZIP file whose members are all stored, not compressed: several
`archive/data-NNNNN.warc.gz` of records, a gzip member each, and for each of them
`indexes/index-NNNNN.cdxj` of lines `key timestamp {json}`, which name a record's
place in its member.  `directory` reads the end of a file, its central directory
(ZIP64 or not) and the local headers of the members asked for, so the byte range
of a member in the file is known; `entries` reads the indexes; `records` then
reads each record by its own byte range.  Files are opened by URI (any file
system that pyarrow knows), so nothing but those ranges is read.

Of pages with equal payloads (by SHA-256) of at least `LEAST` bytes, the one of
the smallest id is a response and holds the payload; the others are revisits,
records with the headers alone that refer to it.  How often a payload occurs is
counted on digests; payloads are shuffled only to find the first of rows that
agree in id and payload, and where the repeated payloads are too many to
broadcast their digests.

Files go to a new folder of the shared folder, a task's into files of its own
under new names, so a task that runs again leaves its first files unread.  A
member is buffered up to `MEMBER` bytes, a file closed beyond `ARCHIVE` bytes.

Defined results: a null html is empty; a null id comes after all others; of rows
that agree in id and payload the first by url (nulls first) counts as the
smaller, and equal rows are a response and revisits of it; payloads shorter than
LEAST are responses always; an empty table gives no records; columns beside
id, url and html are ignored.  A broken archive is an error that says what is
broken where.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateforge.llm import kit

LEAST, MEMBER, ARCHIVE = 100, 16 << 20, 256 << 20
#: Repeated payloads up to which their digests are broadcast (40 bytes each).
FEW = 500_000
#: A fixed time of capture, so that equal pages give equal records.
WHEN = "2024-01-01T00:00:00Z"
#: Fixed values of the formats: signatures, sizes of the fixed parts, and where 64-bit fields take over.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR_SIZE = 30, 46, 22, 56, 20
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Broken(ValueError):
    """An archive or a record that its headers do not describe."""


# ---------------------------------------------------------------- writing


class Archive:
    """A ZIP file of stored members, written front to back; `wide` uses the 64-bit fields throughout."""

    def __init__(self, out: BinaryIO, wide: bool = False):
        self.out, self.wide, self.at, self.members = out, wide, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        wide = self.wide or len(data) >= MAX32 or self.at >= MAX32
        title, crc = name.encode(), zlib.crc32(data)
        self.members.append((title, crc, len(data), self.at))
        small = MAX32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        self.put(struct.pack("<4s5H3L2H", LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, small, small, len(title), len(extra)) + title + extra)
        self.put(data)

    def close(self) -> None:
        start = self.at
        for title, crc, size, at in self.members:
            wide = self.wide or size >= MAX32 or at >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            small, place = (MAX32, MAX32) if wide else (size, at)
            self.put(struct.pack("<4s6H3L5H2L", CENTRAL, 45 if wide else 20, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, small, small, len(title), len(extra), 0, 0, 0, 0, place) + title + extra)
        n, size = len(self.members), self.at - start
        wide = self.wide or n >= MAX16 or start >= MAX32 or size >= MAX32
        if wide:
            end = self.at
            self.put(struct.pack("<4sQ2H2L4Q", END64, END64_SIZE - 12, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sLQL", LOCATOR, 0, end, 1))
        self.put(struct.pack("<4s4H2LH", END, 0, 0, MAX16 if wide else n, MAX16 if wide else n, MAX32 if wide else size, MAX32 if wide else start, 0))


def record_id(page_id: object) -> str:
    return f"<urn:page:{'null' if page_id is None else 'x' + str(page_id).encode().hex()}>"


def page_of(urn: str) -> str | None:
    """The id, as text, in what record_id made."""
    found = re.fullmatch(r"<urn:page:(?:null|x([0-9a-f]*))>", urn)
    if not found:
        raise Broken(f"no record id: {urn}")
    return None if found[1] is None else bytes.fromhex(found[1]).decode()


def record(page_id: object, url: str | None, digest: str, size: int, payload: bytes | None, refers: object = None) -> bytes:
    """A WARC record: a response with its payload, or without one a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {WHEN}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}"]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def cdxj(url: str | None, offset: int, length: int, member: str, digest: str) -> str:
    """An index line: host parts backwards and path as the key, time, and where the record is."""
    host, _, path = re.sub(r"^[a-z]+://", "", (url or "").lower()).partition("/")
    key = re.sub(r"\s", "+", ",".join(reversed(host.split("."))) + ")/" + path)
    return f"{key} {re.sub(r'[^0-9]', '', WHEN)} " + json.dumps({"url": url, "mime": "text/html", "status": 200, "digest": f"sha256:{digest}", "offset": offset, "length": length, "filename": member}) + "\n"


def file_system(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


class Writer:
    """Archives of one task: members of about MEMBER bytes, files of about ARCHIVE bytes."""

    def __init__(self, folder: str, wide: bool = False):
        self.folder, self.wide, self.archive, self.done = folder, wide, None, []

    def add(self, url: str | None, digest: str, data: bytes) -> None:
        if self.archive is None:
            self.uri = f"{self.folder}/{uuid.uuid4().hex}.wacz"
            where, path = file_system(self.uri)
            self.file = where.open_output_stream(path)
            self.archive, self.n, self.records = Archive(self.file, self.wide), 0, 0
            self.fresh()
        packed = gzip.compress(data, 6, mtime=0)
        self.lines.append(cdxj(url, self.size, len(packed), self.member, digest))
        self.parts.append(packed)
        self.size += len(packed)
        self.records += 1
        if self.size >= MEMBER:
            self.flush()
            if self.archive.at >= ARCHIVE:
                self.close()

    def fresh(self) -> None:
        self.member, self.parts, self.lines, self.size = f"archive/data-{self.n:05d}.warc.gz", [], [], 0

    def flush(self) -> None:
        if self.parts:
            self.archive.add(self.member, b"".join(self.parts))
            self.archive.add(f"indexes/index-{self.n:05d}.cdxj", "".join(sorted(self.lines)).encode())
            self.n += 1
        self.fresh()

    def close(self) -> None:
        if self.archive is not None:
            self.flush()
            self.archive.close()
            self.file.close()
            self.done.append((self.uri, self.records, self.archive.at))
            self.archive = None


def typed(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, digest, size, refers: to which id, revisit) of every row; html is null for revisits."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    large = base.where(F.col("size") >= LEAST)
    known = F.struct(F.col("id").isNull().alias("none"), "id")
    each = large.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy(F.col("digest").alias("_d")).agg(F.sum("n").alias("_n"), F.min(F.struct(known.alias("known"), "n")).alias("_first")).where(F.col("_n") > 1).select("_d", F.col("_first.known.id").alias("_id"), (F.col("_first.n") > 1).alias("_tied"))
    first = kit.bounded_broadcast(kit.written(first, "first"), FEW)
    met = base.join(first, (F.col("digest") == F.col("_d")) & (F.col("size") >= LEAST), "left")
    is_first = F.col("_d").isNull() | F.col("id").eqNullSafe(F.col("_id"))
    tied = F.coalesce(F.col("_tied") & is_first, F.lit(False))
    plain = met.where(~tied).withColumn("revisit", ~is_first).withColumn("refers", F.when(F.col("revisit"), F.col("_id")))
    # rows that agree in id and payload: combined by url, as often as they occur
    same = met.where(tied).groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("n"), F.first("html").alias("html"), F.first("size").alias("size"))
    url = F.struct(F.col("url").isNotNull().alias("known"), "url")
    least = same.groupBy(F.col("digest").alias("_d")).agg(F.min(url).alias("_least"))
    again = same.join(least, F.col("digest") == F.col("_d")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("revisit", ~((F.col("_k") == 1) & (url == F.col("_least")))).withColumn("refers", F.when(F.col("revisit"), F.col("id")))
    columns = ["id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "digest", "size", "refers", "revisit"]
    return plain.select(*columns).unionByName(again.select(*columns))


def write_archives(pages: DataFrame, folder: str, *, wide: bool = False, **columns: str) -> DataFrame:
    """Archives of all rows in a folder: a table of (archive, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, wide)
        for batch in batches:
            for i, url, html, digest, size, refers, revisit in zip(*(batch.column(k) for k in range(7)), strict=True):
                digest, url = digest.as_py(), url.as_py()
                payload = None if revisit.as_py() else html.as_py().encode()
                writer.add(url, digest, record(i.as_py(), url, digest, size.as_py(), payload, refers.as_py()))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.done, strict=True)], ["archive", "records", "bytes"])

    where, path = file_system(folder)
    where.create_dir(path, recursive=True)
    spark = pages.sparkSession
    with kit.small_batches(spark, 500):
        return kit.written(typed(pages, **columns).mapInArrow(run, "archive string, records long, bytes long"), "archives", compact=False)


# ---------------------------------------------------------------- reading


@dataclass
class Member:
    """A member of an archive: where its directory says it is, and where its bytes are."""

    name: str
    method: int
    size: int
    header: int
    start: int = -1


def read_at(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise Broken(f"cut off: {size} bytes at {at}, of which {len(data)} are there")
    return data


def _wide(extra: bytes, *fields: int) -> list[int]:
    """Directory fields; those that are all ones stand in the 64-bit extra field, in order."""
    found, at = b"", 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            found = extra[at + 4 : at + 4 + n]
        at += 4 + n
    out = []
    for x in fields:
        if x == MAX32:
            if len(found) < 8:
                raise Broken("a 64-bit field is missing")
            x, found = struct.unpack("<Q", found[:8])[0], found[8:]
        out.append(x)
    return out


def directory(file, size: int) -> list[Member]:
    """The members of an archive of that size, from its end and its central directory."""
    tail = min(size, END_SIZE + MAX16)
    data = read_at(file, size - tail, tail)
    at = data.rfind(END)
    while at >= 0 and (len(data) - at < END_SIZE or at + END_SIZE + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(END, 0, at)
    if at < 0:
        raise Broken("no end of a ZIP directory")
    disk, first, here, n, length, start = struct.unpack_from("<4H2L", data, at + 4)
    end = size - tail + at
    if MAX16 in (n, here) or MAX32 in (length, start):
        if end < LOCATOR_SIZE:
            raise Broken("the 64-bit directory is missing")
        sign, disk, place, _ = struct.unpack("<4sLQL", read_at(file, end - LOCATOR_SIZE, LOCATOR_SIZE))
        if sign != LOCATOR:
            raise Broken("the 64-bit directory is missing")
        sign, _, _, _, disk, first, here, n, length, start = struct.unpack("<4sQ2H2L4Q", read_at(file, place, END64_SIZE))
        if sign != END64:
            raise Broken("the 64-bit directory is not where its locator says")
    if disk or first or here != n:
        raise Broken("archives of several disks aren't read")
    if start + length > end:
        raise Broken("the directory reaches beyond its end")
    data, at, out = read_at(file, start, length), 0, []
    for _ in range(n):
        if len(data) - at < CENTRAL_SIZE or data[at : at + 4] != CENTRAL:
            raise Broken(f"member {len(out)} of {n} has no directory header")
        method, stored, whole = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<2L", data, at + 20)
        title, extra, comment = struct.unpack_from("<3H", data, at + 28)
        (header,) = struct.unpack_from("<L", data, at + 42)
        body = at + CENTRAL_SIZE
        whole, stored, header = _wide(data[body + title : body + title + extra], whole, stored, header)
        out.append(Member(data[body : body + title].decode("utf-8", "replace"), method, stored, header))
        at = body + title + extra + comment
    return out


def located(file, member: Member) -> Member:
    """A stored member with the place of its first byte, which its local header tells."""
    if member.method:
        raise Broken(f"{member.name} is compressed (method {member.method}), so it has no byte ranges")
    head = read_at(file, member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise Broken(f"{member.name} has no local header")
    title, extra = struct.unpack_from("<2H", head, 26)
    member.start = member.header + LOCAL_SIZE + title + extra
    return member


def opened(uri: str):
    """A file for reading by ranges, and its size."""
    where, path = file_system(uri)
    file = where.open_input_file(path)
    return file, file.size()


def indexed(file, size: int) -> Iterator[tuple[int, int, str]]:
    """(offset in the archive, length, digest) of every record that the archive's indexes list."""
    members = directory(file, size)
    by_name = {m.name: m for m in members}
    for m in members:
        if not re.fullmatch(r"indexes/.*\.cdxj?", m.name):
            continue
        m = located(file, m)
        for line in filter(None, read_at(file, m.start, m.size).decode().split("\n")):
            entry = json.loads(line.split(" ", 2)[2])
            data = by_name.get(entry["filename"]) or by_name.get(f"archive/{entry['filename']}")
            if data is None:
                raise Broken(f"{m.name} names {entry['filename']}, which isn't there")
            if data.start < 0:
                located(file, data)
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset < 0 or offset + length > data.size:
                raise Broken(f"{m.name}: a record beyond the end of {data.name}")
            yield data.start + offset, length, entry["digest"].removeprefix("sha256:")


def parsed(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's headers (names in lower case), those of its HTTP block, and the payload."""
    data = gzip.decompress(packed) if packed[:2] == b"\x1f\x8b" else packed
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise Broken("no WARC record")
    fields = lambda x: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in x)}
    headers = fields(lines[1:])
    size = int(headers["content-length"])
    if len(rest) < size:
        raise Broken("a record is shorter than its headers say")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, fields(http.decode().split("\r\n")[1:]), payload


def entries(archives: DataFrame) -> DataFrame:
    """(archive, offset, length) of every record, from the archives' directories and indexes alone; archives are dealt to the tasks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file, size = opened(uri)
                with file:
                    rows = [(uri, at, n) for at, n, _ in indexed(file, size)]
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 10_000], strict=True)], ["archive", "offset", "length"])

    tasks = min(archives.count(), int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(max(1, tasks)).mapInArrow(run, "archive string, offset long, length long")


def records(found: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """(record_id, record_type, refers_id, url, payload_bytes, payload_digest[, payload]) of entries, each read by its range.

    A response's payload is read and hashed, and must have the digest of its header; a
    revisit's size and digest are those of its headers.
    """
    fields = "record_id string, record_type string, refers_id string, url string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def one(packed: bytes) -> tuple:
        headers, http, payload = parsed(packed)
        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
        size = int(http["content-length"])
        if kind == "response":
            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                raise Broken(f"{headers['warc-record-id']}: the payload isn't what its headers say")
        elif kind != "revisit":
            raise Broken(f"{headers['warc-record-id']}: a {kind} record")
        refers = headers.get("warc-refers-to")
        row = (page_of(headers["warc-record-id"]), kind, page_of(refers) if refers else None, headers["warc-target-uri"], size, digest)
        return (*row, payload) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            rows = []
            for uri, at, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if uri != now:
                    if file is not None:
                        file.close()
                    now, (file, _) = uri, opened(uri)
                try:
                    rows.append(one(read_at(file, at, n)))
                except (ValueError, KeyError, OSError, EOFError, zlib.error) as e:
                    raise Broken(f"{uri} at {at}: {e}") from e
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if file is not None:
            file.close()

    return found.select("archive", "offset", "length").mapInArrow(run, fields)


def archived(spark: SparkSession, uris: list[str]) -> DataFrame:
    """Archives by their URIs, as `entries` takes them."""
    return spark.createDataFrame([(u,) for u in uris], T.StructType([T.StructField("archive", T.StringType())]))


def packed(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every row, written to archives and read back."""
    folder = f"{kit.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col)
    kind = pages.schema[id_col].dataType
    return records(entries(archives)).select(F.col("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_id").cast(kind).alias("refers_to"))
