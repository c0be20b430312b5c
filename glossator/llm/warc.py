"""WARC records in ZIP packages: written as stored members with an index, read by ranges without extraction.

A package is a ZIP file with ``archive/data.warc.gz`` (one gzip member a record), ``indexes/index.cdxj`` (one line a
record: the sorted key of its address, its date, and JSON with digest, offset and length) and ``datapackage.json``
(sizes and checksums). All members are stored, so a record lies in the package as it lies in the archive. A reader
takes the end of the file, finds the central directory there (by way of the ZIP64 record where numbers are too large
for the old one), looks up where a member's bytes begin in its local header, reads the index, and then only the
ranges of the records that are asked for. Nothing is unpacked but these.

Packages of other makers can be read too: plain ``.warc`` members, several archives and indexes in one package,
indexes that are deflated or gzipped, comments and bytes before the first member. An archive without an index is
scanned record by record. An archive member that is itself compressed has no ranges, and is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import fresh_path, give_back, open_fs, publish, qualified, small

# Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
LOCAL_HEAD, CENTRAL_HEAD, END_HEAD, END64_HEAD, LOCATOR_HEAD = "<IHHHHHIIIHH", "<IHHHHHHIIIHHHHHII", "<IHHHHIIH", "<IQHHIIQQQQ", "<IIQI"
FULL, FULL_SHORT, EXTRA64 = 0xFFFFFFFF, 0xFFFF, 0x0001
STORED, DEFLATED = 0, 8
#: Flags of our members: names are UTF-8, and, for the archive, sizes follow the bytes.
UTF8, STREAMED = 0x0800, 0x0008
#: 1980-01-01, the least date that a member can have.
MEMBER_DATE = 0x21

ARCHIVE, INDEX, CONTENTS = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: A package is closed beyond so many bytes or records, for its index is held while it is written.
PACKAGE_BYTES, PACKAGE_RECORDS = 1 << 30, 100_000
#: Neighbouring records are read together up to so many bytes.
RANGE = 4 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = re.compile(r"<urn:x-page:(-?\d*):[A-Z2-7]*:[0-9a-f-]+>")


# --- packages -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int


ReadAt = Callable[[int, int], bytes]


def wide(fields: list[int], extra: bytes) -> list[int]:
    """Size, packed size and offset of a directory entry, taken from the ZIP64 field where they are full."""
    i = 0
    while i + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, i)
        if kind == EXTRA64:
            at, out = i + 4, []
            for x in fields:
                if x == FULL:
                    out.append(struct.unpack_from("<Q", extra, at)[0])
                    at += 8
                else:
                    out.append(x)
            return out
        i += 4 + n
    return fields


def directory(read_at: ReadAt, size: int) -> list[Member]:
    """The members of a package, from its central directory."""
    start = max(0, size - struct.calcsize(END_HEAD) - FULL_SHORT)
    tail = read_at(start, size - start)
    at = len(tail)
    while True:
        at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        if at + struct.calcsize(END_HEAD) <= len(tail):
            end = struct.unpack_from(END_HEAD, tail, at)
            if at + struct.calcsize(END_HEAD) + end[7] == len(tail):  # the comment ends with the file
                break
        at += 3
    count, length, offset, behind = end[4], end[5], end[6], start + at
    locator = start + at - struct.calcsize(LOCATOR_HEAD)
    if FULL_SHORT in (end[3], count) or FULL in (length, offset):
        found = struct.unpack(LOCATOR_HEAD, read_at(locator, struct.calcsize(LOCATOR_HEAD))) if locator >= 0 else (0,)
        if found[0] == LOCATOR:
            # Where bytes precede the first member, the record lies right before its locator all the same.
            for behind in (found[2], locator - struct.calcsize(END64_HEAD)):
                if not 0 <= behind <= locator - struct.calcsize(END64_HEAD):
                    continue
                end64 = struct.unpack(END64_HEAD, read_at(behind, struct.calcsize(END64_HEAD)))
                if end64[0] == END64:
                    count, length, offset = end64[7:10]
                    break
            else:
                raise ValueError("no ZIP64 end of a central directory")
    shift = behind - length - offset
    if shift < 0:
        raise ValueError("the central directory reaches beyond the package")
    raw, members, i = read_at(offset + shift, length), [], 0
    for _ in range(count):
        if i + struct.calcsize(CENTRAL_HEAD) > len(raw):
            raise ValueError("the central directory is cut off")
        signature, _, _, flags, method, _, _, crc, packed, full, n, m, k, _, _, _, header = struct.unpack_from(CENTRAL_HEAD, raw, i)
        if signature != CENTRAL:
            raise ValueError("the central directory is damaged")
        i += struct.calcsize(CENTRAL_HEAD)
        full, packed, header = wide([full, packed, header], raw[i + n : i + n + m])
        name = raw[i : i + n].decode("utf-8" if flags & UTF8 else "cp437")
        members.append(Member(name, method, flags, crc, packed, full, header + shift))
        i += n + m + k
    return members


def content_start(read_at: ReadAt, m: Member) -> int:
    """Where a member's bytes begin: its local header may have other extra fields than the directory."""
    head = read_at(m.header, struct.calcsize(LOCAL_HEAD))
    if len(head) < struct.calcsize(LOCAL_HEAD) or struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"{m.name}: no local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return m.header + len(head) + n + extra


def content(read_at: ReadAt, m: Member) -> bytes:
    """A whole member, unpacked and verified: for indexes and contents."""
    raw = read_at(content_start(read_at, m), m.packed)
    if m.method == DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif m.method != STORED:
        raise ValueError(f"{m.name}: packed by method {m.method}")
    if len(raw) != m.size or zlib.crc32(raw) != m.crc:
        raise ValueError(f"{m.name}: its bytes are damaged")
    return raw


class PackageWriter:
    """Writes one package; it appears under its name when it is complete. The archive is written as it comes, so only
    index lines are held."""

    def __init__(self, path: str, attempt: str = "0", date: str = DATE, zip64: bool = False):
        self.fs, self.path = open_fs(path)
        self.part, self.date, self.zip64 = f"{self.path}.{attempt}.part", date, zip64
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.at, self.records, self.lines, self.members = 0, 0, [], []
        self.hash = hashlib.sha256()
        name = ARCHIVE.encode()
        extra = struct.pack("<HHQQ", EXTRA64, 16, 0, 0)  # its sizes follow it, in 64 bits
        self._put(struct.pack(LOCAL_HEAD, LOCAL, 45, UTF8 | STREAMED, STORED, 0, MEMBER_DATE, 0, FULL, FULL, len(name), len(extra)) + name + extra)
        self.start, self.crc = self.at, 0
        about = f"software: glossator\r\nformat: WARC File Format 1.1\r\ndate: {date}\r\n".encode()
        self._record(block(("warcinfo", f"<urn:x-package:{self.path.rsplit('/', 1)[1]}>", date, "application/warc-fields"), [], about))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _record(self, raw: bytes) -> tuple[int, int]:
        """Offset and length in the archive of a record that is added to it."""
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        offset = self.at - self.start
        self.crc = zlib.crc32(packed, self.crc)
        self.hash.update(packed)
        self._put(packed)
        return offset, len(packed)

    def add(self, record: bytes, url: str, kind: str, digest: str) -> None:
        offset, length = self._record(record)
        told = {"url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "offset": str(offset), "length": str(length), "filename": ARCHIVE.rsplit("/", 1)[1]}
        self.lines.append(f"{address_key(url)} {re.sub(r'[^0-9]', '', self.date)} {json.dumps(told, ensure_ascii=False)}\n")
        self.records += 1

    def size(self) -> int:
        return self.at

    def _member(self, name: str, raw: bytes) -> None:
        header, name_raw = self.at, name.encode()
        self._put(struct.pack(LOCAL_HEAD, LOCAL, 20, UTF8, STORED, 0, MEMBER_DATE, zlib.crc32(raw), len(raw), len(raw), len(name_raw), 0) + name_raw + raw)
        self.members.append((name_raw, UTF8, zlib.crc32(raw), len(raw), header))

    def close(self) -> None:
        size = self.at - self.start
        self._put(struct.pack("<IIQQ", DESCRIPTOR, self.crc, size, size))
        self.members.append((ARCHIVE.encode(), UTF8 | STREAMED, self.crc, size, 0))
        index = "".join(sorted(self.lines)).encode("utf-8", "surrogatepass")
        self._member(INDEX, index)
        files = [{"name": n.rsplit("/", 1)[1], "path": n, "hash": f"sha256:{h}", "bytes": b} for n, h, b in ((ARCHIVE, self.hash.hexdigest(), size), (INDEX, hashlib.sha256(index).hexdigest(), len(index)))]
        self._member(CONTENTS, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "created": self.date, "resources": files}).encode())
        start = self.at
        most = -1 if self.zip64 else FULL - 1
        for name, flags, crc, n, header in self.members:
            large = [x for x in (n, n, header) if x > most]
            extra = struct.pack(f"<HH{len(large)}Q", EXTRA64, 8 * len(large), *large) if large else b""
            n32, header32 = (FULL if x > most else x for x in (n, header))
            self._put(struct.pack(CENTRAL_HEAD, CENTRAL, 45, 45, flags, STORED, 0, MEMBER_DATE, crc, n32, n32, len(name), len(extra), 0, 0, 0, 0, header32) + name + extra)
        length, count = self.at - start, len(self.members)
        if max(start, length) > most:
            end64 = self.at
            self._put(struct.pack(END64_HEAD, END64, struct.calcsize(END64_HEAD) - 12, 45, 45, 0, 0, count, count, length, start))
            self._put(struct.pack(LOCATOR_HEAD, LOCATOR, 0, end64, 1))
        self._put(struct.pack(END_HEAD, END, 0, 0, count, count, *(FULL if x > most else x for x in (length, start)), 0))
        self.out.close()
        publish(self.fs, self.part, self.path)


# --- records --------------------------------------------------------------------------------------


def block(head: tuple[str, str, str, str], fields: list[tuple[str, str]], body: bytes) -> bytes:
    """A WARC record: (type, id, date, content type), further fields, and its block."""
    kind, record_id, date, content_type = head
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Type", content_type), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, copy: str = "0") -> str:
    """``copy`` is 0 for a response that others refer to."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}:{copy}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def target(url: str | None, page_id: int | None) -> str:
    """An address that fits a header: without one the page's name; white space and control characters escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url) if url else f"urn:x-page:{'' if page_id is None else page_id}"


def page_record(own_id: str, url: str, date: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit, whose HTTP header alone tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = "response" if refers_to is None else "revisit"
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to)]
    body = http + payload if refers_to is None else http
    fields.append(("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(body).digest())}"))
    return block((kind, own_id, date, "application/http; msgtype=response"), fields, body)


def address_key(url: str) -> str:
    """The address with its host's names in reverse, so that an index sorts by site."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname, f":{parts.port}" if parts.port else ""
    except ValueError:
        host = None
    if not host:
        return url.lower()
    return f"{','.join(reversed(host.removeprefix('www.').split('.')))}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def headers(raw: bytes) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name (lines that begin with white space go on), and where they end."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record without an end of its header")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", raw[:end].decode("utf-8", "surrogatepass")).split("\r\n")
    fields = {}
    for line in lines:
        k, _, v = line.partition(":")
        fields.setdefault(k.strip().lower(), v.strip())
    return first, fields, end + 4


def digest_of(told: str | None) -> str | None:
    """The bare digest, upper-case, of ``sha1:...``; null for other algorithms."""
    name, _, value = (told or "").partition(":")
    return value.upper() if name.lower() == "sha1" and value else None


def parsed(raw: bytes) -> dict:
    """A record's fields; its payload and block are verified by the digests that they have."""
    first, fields, at = headers(raw)
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    n = int(fields.get("content-length", "0"))
    body = raw[at : at + n]
    if len(body) != n:
        raise ValueError("a record is cut off")
    told = digest_of(fields.get("warc-block-digest"))
    if told and told != base32(hashlib.sha1(body).digest()):
        raise ValueError(f"{fields.get('warc-record-id')}: its block is damaged")
    kind, payload, size = fields.get("warc-type"), body, n
    if fields.get("content-type", "").startswith("application/http"):
        _, http, end = headers(body)
        payload = body[end:]
        size = int(http.get("content-length", len(payload)))
    elif kind == "revisit":
        size = None
    digest = digest_of(fields.get("warc-payload-digest"))
    if kind == "revisit":
        payload = None
    else:
        own = base32(hashlib.sha1(payload).digest())
        if digest and digest != own:
            raise ValueError(f"{fields.get('warc-record-id')}: its payload is damaged")
        digest, size = own, len(payload)
    mine, other = (RECORD_ID.fullmatch(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    number = lambda m: int(m[1]) if m and m[1] else None
    return {"record_id": fields.get("warc-record-id"), "record_type": kind, "page_id": number(mine), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_digest": digest, "payload_bytes": size, "refers_to": fields.get("warc-refers-to"), "refers_to_page": number(other), "payload": payload}


# --- readers --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Place:
    """A record's range in an archive; length 0 if its end is not known."""

    archive: str
    offset: int
    length: int
    url: str | None = None


class PackageReader:
    """Range reads of a package's records."""

    def __init__(self, path: str):
        self.fs, self.path = open_fs(path)
        self.file = self.fs.open_input_file(self.path)
        self.bytes_read = 0
        self.members = directory(self.read_at, self.file.size())
        self.archives = {m.name.rsplit("/", 1)[-1]: m for m in self.members if re.search(r"\.warc(\.gz)?$", m.name)}
        self.starts: dict[str, int] = {}

    def read_at(self, offset: int, n: int) -> bytes:
        raw = self.file.read_at(n, offset)
        self.bytes_read += len(raw)
        return raw

    def start(self, archive: str) -> int:
        m = self.archives[archive]
        if m.method != STORED:
            raise ValueError(f"{m.name}: is compressed as a member, so its records have no ranges")
        if archive not in self.starts:
            self.starts[archive] = content_start(self.read_at, m)
        return self.starts[archive]

    def places(self) -> list[Place]:
        """All records by archive and offset, from the indexes; archives that no index tells of are scanned."""
        found = []
        for m in self.members:
            if re.search(r"\.cdxj?(\.gz)?$", m.name):
                raw = content(self.read_at, m)
                raw = zlib_members(raw) if m.name.endswith(".gz") else raw
                for line in raw.decode("utf-8", "surrogatepass").split("\n"):
                    told = line.partition("{")
                    if not told[1] or line.startswith("!"):
                        continue
                    told = json.loads("{" + told[2])
                    archive = str(told.get("filename", "")).rsplit("/", 1)[-1]
                    if archive in self.archives and "offset" in told:
                        found.append(Place(archive, int(told["offset"]), int(told.get("length", 0)), told.get("url")))
        known = {p.archive for p in found}
        return sorted({*found, *(p for a in self.archives if a not in known for p in self.scanned(a))}, key=lambda p: (p.archive, p.offset, p.length, p.url or ""))

    def raw(self, places: list[Place]) -> Iterator[bytes]:
        """The records at the places, in order; neighbours come in one read."""
        i = 0
        while i < len(places):
            p, j = places[i], i + 1
            end = p.offset + p.length
            while p.length and j < len(places) and places[j].archive == p.archive and places[j].length and places[j].offset <= end + 4096 and places[j].offset + places[j].length - p.offset <= RANGE:
                end = max(end, places[j].offset + places[j].length)
                j += 1
            if not p.length:  # up to the end of its gzip member or block
                yield next(self.records_from(p.archive, p.offset))[2]
            else:
                held = self.read_at(self.start(p.archive) + p.offset, end - p.offset)
                for x in places[i:j]:
                    part = held[x.offset - p.offset : x.offset - p.offset + x.length]
                    if len(part) != x.length:
                        raise ValueError(f"{self.path}: a record lies beyond {x.archive}")
                    yield zlib_members(part) if x.archive.endswith(".gz") else part
            i = j

    def records(self, places: list[Place] | None = None) -> Iterator[dict]:
        """The records at the places (all, if none are given), as fields."""
        for raw in self.raw(self.places() if places is None else places):
            yield parsed(raw)

    def scanned(self, archive: str) -> Iterator[Place]:
        """The places of an archive's records of pages, found by going through it."""
        for offset, length, raw in self.records_from(archive, 0):
            if headers(raw)[1].get("warc-type") != "warcinfo":
                yield Place(archive, offset, length)

    def records_from(self, archive: str, offset: int) -> Iterator[tuple[int, int, bytes]]:
        """Offset, length and bytes of each record from an offset on, read in blocks."""
        start, size = self.start(archive), self.archives[archive].size
        more = lambda at: self.read_at(start + at, min(RANGE, size - at))
        if archive.endswith(".gz"):
            while offset < size:
                unpack, out, at = zlib.decompressobj(31), [], offset
                while not unpack.eof:
                    if at >= size:
                        raise ValueError(f"{archive}: a record is cut off")
                    held = more(at)
                    out.append(unpack.decompress(held))
                    at += len(held)
                at -= len(unpack.unused_data)
                yield offset, at - offset, b"".join(out)
                offset = at
            return
        while offset < size:
            held = more(offset)
            while b"\r\n\r\n" not in held and offset + len(held) < size:
                held += more(offset + len(held))
            _, fields, end = headers(held)
            length = end + int(fields.get("content-length", "0")) + 4
            held = held[:length] if length <= len(held) else held + self.read_at(start + offset + len(held), length - len(held))
            yield offset, length, held
            offset += length


def zlib_members(raw: bytes) -> bytes:
    """All gzip members of the bytes, unpacked."""
    out = []
    while raw:
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(raw) + unpack.flush())
        if not unpack.eof:
            raise ValueError("a gzip member is cut off")
        raw = unpack.unused_data
    return b"".join(out)


# --- operators ------------------------------------------------------------------------------------

MANIFEST = "path string, records long, bytes long"
RECORD = "path string, record_id string, record_type string, page_id long, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, refers_to_page long, payload binary, error string"


def elected(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, payload, sha1, n, copies and top (page_id, url) of the page that has the response, null where the
    payload is no other page's.

    A payload's pages are counted by (payload, salt) first, so that one with a third of all pages is as many keys as
    there are salts, in the count and in the join. Payloads are told apart by SHA-1, another hash and length.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha1("payload")).alias("sha1"), F.xxhash64("payload").alias("h"), F.length("payload").alias("n"))
    own = ["page_id", "url", "sha1", "h", "n"]
    if rows.groupBy(F.xxhash64(*own)).count().where("count > 1").limit(1).count():
        # Equal rows are one with a count, combined before they are shuffled.
        rows = rows.groupBy(*own).agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["sha1", "h", "n"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    by_salt = rows.where(F.col("n") >= least).groupBy(*key, "salt").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("copies").alias("c"))
    tops = by_salt.groupBy(*key).agg(F.max("top").alias("top"), F.sum("c").alias("c")).where("c > 1").drop("c")
    told = by_salt.select(*key, "salt").join(tops, key)
    return rows.join(told.hint("shuffle_hash"), [*key, "salt"], "left").select("page_id", "url", "payload", "sha1", "n", "copies", "top")


def write_packages(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, least: int = 0) -> DataFrame:
    """Writes each page as a WARC record and returns the manifest: path, records and bytes of every package.

    Of the pages whose payloads (html in UTF-8; null counts as empty) are equal and have ``least`` bytes or more, the
    one with the largest page_id is a response and the others are revisits of it; shorter ones are all responses.
    A null page_id is the smallest; of pages that repeat page_id and payload the largest url comes first (a null one
    last); of rows that repeat all three, one is the response. A page without an address gets one of its page_id. An
    empty table gives an empty manifest. Other columns are ignored.

    Each task writes packages of its own, under names that depend on its partition only, so a task that is run again
    replaces what it wrote before.
    """
    spark = pages.sparkSession
    path = qualified(spark, path or fresh_path(spark, "packages"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out, number = None, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.records], pa.int64()), pa.array([out.size()], pa.int64())], names=["path", "records", "bytes"])

        for b in small(batches):
            for r in b.to_pylist():
                digest, address = base32(r["sha1"]), target(r["url"], r["page_id"])
                top = r["top"]
                chosen = top is None or (top["page_id"], top["url"]) == (r["page_id"], r["url"])
                for copy in range(r["copies"]):
                    if out is None:
                        name = f"{path}/{task.partitionId():06d}-{number:04d}.wacz"
                        out = PackageWriter(name, str(task.taskAttemptId()), date)
                    first = chosen and (copy == 0 or top is None)
                    refers_to = None if first else record_id(top["page_id"], digest)
                    own = record_id(r["page_id"], digest, "0" if first and top is not None else f"{zlib.crc32(address.encode('utf-8', 'surrogatepass')):08x}-{copy}")
                    out.add(page_record(own, address, date, r["payload"], r["n"], digest, refers_to), address, "response" if first else "revisit", digest)
                    if out.size() > PACKAGE_BYTES or out.records >= PACKAGE_RECORDS:
                        yield done()
                        out, number = None, number + 1
        if out is not None:
            yield done()

    made = elected(pages, page_id, url, html, least).mapInArrow(write, MANIFEST)
    made.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def dealt(manifest: DataFrame) -> DataFrame:
    """A package to a partition, about: they are as large as partitions are."""
    n = min(100_000, max(1, manifest.count()))
    return manifest.select("path").repartitionByRange(n, "path")


def record_frame(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def read_packages(manifest: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """All records of the packages in manifest (path): path, record_id, record_type, page_id (of records written here),
    target_uri, date, payload_digest (bare SHA-1), payload_bytes, refers_to (a record id), refers_to_page, payload (null
    for revisits) and error.

    Payloads are verified by their digests. What cannot be read raises; with ``strict`` off the package's remaining
    records are one row with the error.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                try:
                    for record in PackageReader(path).records():
                        size += 512 + len(record["payload"] or b"") * with_payload
                        held.append(record | {"path": path} if with_payload else record | {"path": path, "payload": None})
                        if size > RANGE:
                            yield record_frame(held)
                            held, size = [], 0
                except (ValueError, OSError, KeyError, struct.error, zlib.error) as e:
                    if strict:
                        raise
                    held.append({"path": path, "error": f"{type(e).__name__}: {e}"})
                yield record_frame(held)
        give_back()

    return dealt(manifest).mapInArrow(read, RECORD)


def lookup_records(manifest: DataFrame, urls: list[str]) -> DataFrame:
    """The records of the given addresses, by the indexes: other records are not read."""
    asked = set(urls)

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                reader = PackageReader(path)
                places = [p for p in reader.places() if p.url in asked]
                for record in reader.records(places):
                    yield record_frame([record | {"path": path}])

    return dealt(manifest).mapInArrow(find, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """records in which each revisit has the payload of the response that it refers to. Equal payloads may be many, so
    the response is sent along the revisits' salts, as many as there are of it in each."""
    salts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    revisits = records.where("record_type = 'revisit'").withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)))
    wanted = revisits.select("refers_to", "_salt").distinct()
    payloads = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("_payload"))
    met = wanted.join(payloads, "refers_to")
    told = revisits.join(met, ["refers_to", "_salt"], "left").withColumn("payload", F.coalesce("payload", "_payload")).select(*records.columns)
    return records.where("record_type is null or record_type <> 'revisit'").unionByName(told)


def warc_report(pages: DataFrame, **options) -> DataFrame:
    """Writes pages as packages and returns, from reading them back, page_id, payload_bytes, payload_digest, record_type
    and refers_to (the page_id of a revisit's response)."""
    found = read_packages(write_packages(pages, **options), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))
