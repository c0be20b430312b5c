"""MPEG audio columns: a lossless store of 8-bit samples in Layer III streams, and a parser for any such stream.

A stored text is an ID3v2.3 tag (title "payload", its byte count in a TXXX frame), an information frame with
an Xing table, and audio frames whose main data are empty: all granules are silent and the samples lie in
the ancillary bytes, where any player passes over them. Frames are protected: each has the CRC-16 that the
format defines over the header's second half and the side information. The bit rate varies, so that a frame
is as small as the samples left allow.

The parser takes streams of any MPEG version and layer, with free bit rates too: it reads ID3v1, ID3v2 and APE
tags, finds the next frame header wherever the last frame did not end at one, reads the variable-bit-rate
table (Xing, Info or VBRI) and the encoder's delay and padding, verifies the checksums of all three layers, and
stores the exact duration as a number of samples and a rate, and the byte offset of every frame for seeking.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import small, worker_cache

UNIT = 64

# Fixed values of the format: kbit/s by version group, layer and index; sample rates of MPEG-1.
RATES_1 = {1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
RATES_2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = (44100, 48000, 32000)
VERSIONS = {3: 1, 2: 2, 0: 25}
# Fixed values of Layer II: for each table the (subbands, bits of each one's allocation) from the lowest band up.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}
#: Longest frame that is looked for where the bit rate is free.
LONGEST_FREE = 8192


@dataclass(frozen=True)
class Header:
    """One frame header."""

    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int  # bytes, header included
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def parse_header(word: int) -> Header | None:
    """The header in four bytes; None where there is none, or one of a free or bad bit rate."""
    h = any_header(word)
    return h if h is not None and h.size else None


def any_header(word: int) -> Header | None:
    """parse_header that takes a free bit rate too; the size is 0 then."""
    cache = worker_cache("media").setdefault("mpeg", {})
    key = word & 0xFFFFFFC0  # mode extension, copyright and emphasis don't matter
    if key not in cache:
        if len(cache) > 4096:
            cache.clear()
        cache[key] = _parse_header(word)
    return cache[key]


def _parse_header(word: int) -> Header | None:
    version, layer = VERSIONS.get(word >> 19 & 3), 4 - (word >> 17 & 3)
    rate_index, sample_index = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or rate_index == 15 or sample_index == 3:
        return None
    kbps = (RATES_1 if version == 1 else RATES_2)[layer][rate_index]
    rate = SAMPLE_RATES[sample_index] // {1: 1, 2: 2, 25: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    padding = word >> 9 & 1
    size = 0 if not kbps else (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    return Header(version, layer, not word >> 16 & 1, kbps, rate, word >> 6 & 3 == 3, size, samples)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The format's checksum: polynomial 0x8005, high bit first."""
    cache = worker_cache("media")
    if "crc16" not in cache:
        table = []
        for i in range(256):
            c = i << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
            table.append(c)
        cache["crc16"] = table
    table = cache["crc16"]
    for b in data:
        crc = (crc << 8 & 0xFF00) ^ table[crc >> 8 ^ b]
    return crc


def crc16_bits(data: bytes, start: int, n: int, crc: int) -> int:
    """The checksum carried on over n bits of data from bit ``start`` on."""
    for i in range(start, start + n):
        top = crc >> 15 ^ (data[i >> 3] >> 7 - (i & 7) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def bits(data: bytes, start: int, n: int) -> int:
    return int.from_bytes(data[start >> 3 : (start + n + 7) >> 3], "big") >> (-(start + n) & 7) & (1 << n) - 1


def checked_bits(data: bytes, at: int, h: Header) -> int | None:
    """How many bits after the checksum it covers: side information in Layer III, the bit allocation in Layer I, that
    and the scale factor selection in Layer II; None where the frame ends before."""
    if h.layer == 3:
        return h.side * 8
    channels = 1 if h.mono else 2
    mode = data[at + 3] >> 6
    joint = 4 * (1 + (data[at + 3] >> 4 & 3)) if mode == 1 else 32  # subbands from here on share an allocation
    if h.layer == 1:
        return 4 * sum(channels if band < joint else 1 for band in range(32))
    each = h.kbps // channels
    name = "low" if h.version != 1 else ("d" if h.rate == 32000 else "c") if 0 < each <= 48 else "a" if 0 < each <= 80 or h.rate == 48000 else "b"
    place, chosen, band, end = (at + 6) * 8, 0, 0, len(data) * 8
    for bands, width in ALLOCATION[name]:
        for _ in range(bands):
            told = channels if band < joint else 1
            for _ in range(told):
                if place + width > end:
                    return None
                chosen += (bits(data, place, width) > 0) * (channels // told)
                place += width
            band += 1
    return place - (at + 6) * 8 + 2 * chosen


def sound(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum is right."""
    n = checked_bits(data, at, h)
    if n is None or (at + 6) * 8 + n > len(data) * 8:
        return False
    whole = n // 8
    crc = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + whole])
    return crc16_bits(data, (at + 6 + whole) * 8, n % 8, crc) == int.from_bytes(data[at + 4 : at + 6], "big")


# --- writing --------------------------------------------------------------------------------------

#: MPEG-1 Layer III, protected, mono, 32 kHz.
BASE_WORD = 0xFFFA0000 | 2 << 10 | 3 << 6
SIDE = 17
OVERHEAD = 4 + 2 + SIDE


def frame_kinds() -> list[tuple[int, bytes]]:
    """(sample bytes, bytes before them) of each bit rate, in ascending order."""
    cache = worker_cache("media")
    if "frames" not in cache:
        kinds = []
        for i in range(1, 15):
            word = BASE_WORD | i << 12
            head = struct.pack(">I", word)
            side = bytes(SIDE)
            kinds.append((parse_header(word).size - OVERHEAD, head + struct.pack(">H", crc16(head[2:] + side)) + side))
        cache["frames"] = kinds
    return cache["frames"]


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def payload(text: str | None) -> tuple[int, bytes]:
    """Number of bytes of the text and the bytes padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def store(samples: bytes) -> bytes:
    """The stream that holds these samples."""
    kinds = frame_kinds()
    most, start = kinds[-1]
    frames = []
    full = len(samples) - len(samples) % most
    frames += [start + samples[i : i + most] for i in range(0, full, most)]
    rest = samples[full:]
    if rest:
        room, head = next((k for k in kinds if k[0] >= len(rest)), kinds[-1])
        frames.append(head + rest + bytes(room - len(rest)))
    tag = b"TIT2" + struct.pack(">IH", 8, 0) + b"\0payload"
    said = b"\0payload_bytes\0" + str(len(samples)).encode()
    tag += b"TXXX" + struct.pack(">IH", len(said), 0) + said
    sizes = [len(f) for f in frames]
    total = sum(sizes)
    # The information frame's own size does not hang on what it says: it is the smallest that holds the table.
    room, head = next(k for k in kinds if k[0] >= 116)
    total += OVERHEAD + room
    ends = np.cumsum([OVERHEAD + room, *sizes])
    places = [int(ends[min(len(sizes) - 1, i * len(sizes) // 100)] * 256 // total) if sizes else 0 for i in range(100)]
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(min(255, p) for p in places)
    return b"ID3\x03\x00\x00" + syncsafe(len(tag)) + tag + head + xing + bytes(room - len(xing)) + b"".join(frames)


# --- reading --------------------------------------------------------------------------------------


@dataclass
class Stream:
    """What is in a stream: tags, the table of the information frame, and one entry for each audio frame."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: tuple[str, int | None, int | None, list[int] | None] | None = None  # kind, frames, bytes, seek points
    delay: int = 0  # samples that the encoder put before the sound, and behind it
    padding: int = 0
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    bad_crc: int = 0
    checked: int = 0
    skipped: int = 0  # bytes that belong to no tag or frame

    @property
    def samples(self) -> int:
        """Samples of the sound itself."""
        return max(0, sum(h.samples for h in self.headers) - self.delay - self.padding)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    @property
    def seconds(self) -> float:
        """Each frame at its own rate."""
        whole = sum(h.samples / h.rate for h in self.headers)
        return max(0.0, whole - (self.delay + self.padding) / self.rate) if self.headers else 0.0


def parse(data: bytes) -> Stream:
    """Everything in a stream of MPEG audio; bytes that are no frame are skipped up to the next header that is
    followed by another one of its kind, by a tag, or by the end."""
    out, at, n = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= n:
        size = syncsafe_int(data[at + 6 : at + 10])
        _id3v2(data[at + 10 : at + 10 + size], data[at + 3], data[at + 5], out.tags)
        at += 10 + size + (10 if data[at + 3] == 4 and data[at + 5] & 16 else 0)
    stop = n
    if n - at >= 128 and data[n - 128 : n - 125] == b"TAG":
        stop = n - 128
        for name, a, z in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            value = data[stop + a : stop + z].rstrip(b"\0 ").decode("latin-1")
            if value:
                out.tags.setdefault(name, value)
    stop = _ape(data, at, stop, out.tags)
    first, synced, free = True, False, None
    while at + 4 <= stop:
        word = int.from_bytes(data[at : at + 4], "big")
        h = any_header(word)
        if h is not None and not h.size:
            free = free if synced and free else _free_size(data, at, word, h, stop)
            h = replace(h, size=free + (word >> 9 & 1) * (4 if h.layer == 1 else 1)) if free else None
        if h is None or at + h.size > stop or not (synced or _followed(data, at, h, stop)):
            found = data.find(b"\xff", at + 1, stop)
            nxt = found if found >= 0 else stop
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        if h.protected:
            out.checked += 1
            out.bad_crc += not sound(data, at, h)
        if not (first and _information(data, at, h, out)):
            out.offsets.append(at)
            out.headers.append(h)
        first = False
        at += h.size
    out.skipped += max(0, stop - at)
    return out


def _followed(data: bytes, at: int, h: Header, stop: int) -> bool:
    nxt = at + h.size
    if nxt + 4 > stop:
        return nxt <= stop
    other = any_header(int.from_bytes(data[nxt : nxt + 4], "big"))
    return other is not None and (other.version, other.layer, other.rate) == (h.version, h.layer, h.rate)


def _free_size(data: bytes, at: int, word: int, h: Header, stop: int) -> int | None:
    """Bytes of a frame of free bit rate without padding: up to the next header that agrees in all but the padding,
    and has another one at the same distance unless the stream ends there."""
    fixed = 0xFFFEFC00  # sync, version, layer, bit rate and sample rate
    unit = 4 if h.layer == 1 else 1
    place = at + 24
    while True:
        place = data.find(b"\xff", place, min(stop, at + LONGEST_FREE))
        if place < 0 or place + 4 > stop:
            return None
        other = int.from_bytes(data[place : place + 4], "big")
        if other & fixed == word & fixed:
            size = place - at - (word >> 9 & 1) * unit
            after = place + size + (other >> 9 & 1) * unit
            if after + 4 > stop or int.from_bytes(data[after : after + 4], "big") & fixed == word & fixed:
                return size
        place += 1


def syncsafe_int(raw: bytes) -> int:
    return sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))


def _id3v2(body: bytes, version: int, flags: int, tags: dict[str, str]) -> None:
    """Text frames of a tag of version 2.2, 2.3 or 2.4; unsynchronisation is undone and an extended header passed over."""
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, wide = 0, 4 if version > 2 else 3
    if flags & 64 and version > 2 and len(body) >= 4:
        at = syncsafe_int(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    head = 10 if version > 2 else 6
    while at + head <= len(body) and body[at : at + 1] != b"\0":
        name = body[at : at + wide].decode("latin-1")
        raw = body[at + wide : at + 2 * wide]
        size = syncsafe_int(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + size]
        if version == 4 and body[at + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if version == 4 and body[at + 9] & 1:  # the length without unsynchronisation comes first
            value = value[4:]
        if name[0] == "T" and value:
            text = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0]] if value[0] < 4 else "latin-1", "replace")
            key, _, rest = text.partition("\0")
            own = name in ("TXXX", "TXX")
            tags[key if own else name] = rest if own else text.rstrip("\0")
        at += head + size


def _ape(data: bytes, at: int, stop: int, tags: dict[str, str]) -> int:
    """Reads an APE tag that ends at ``stop``; where the sound ends."""
    foot = stop - 32
    if foot < at or data[foot : foot + 8] != b"APETAGEX":
        return stop
    _, size, items, flags = struct.unpack("<IIII", data[foot + 8 : foot + 24])
    place = stop - size
    if place < at:
        return stop
    start = place - (32 if flags >> 31 else 0)
    for _ in range(items):
        if place + 8 > foot:
            break
        length, kind = struct.unpack("<II", data[place : place + 8])
        end = data.find(b"\0", place + 8, foot)
        if end < 0:
            break
        if not kind >> 1 & 3:  # text
            tags.setdefault(data[place + 8 : end].decode("latin-1"), data[end + 1 : end + 1 + length].decode("utf-8", "replace"))
        place = end + 1 + length
    return start if start >= at else stop


def _information(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads an information frame: counts, seek points (bytes from the frame on), delay and padding. False if it is none."""
    body = at + 4 + (2 if h.protected else 0) + (h.side if h.layer == 3 else 0)
    kind = data[body : body + 4]
    if h.layer == 3 and kind in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
        frames = size = points = None
        if flags & 1:
            frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            size, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            points, p = [b * (size or 0) // 256 for b in data[p : p + 100]], p + 100
        if flags & 8:
            p += 4
        # The encoder's name, then its settings; delay and padding are 12 bits each.
        if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc", b"Gogo") and p + 24 <= at + h.size:
            both = int.from_bytes(data[p + 21 : p + 24], "big")
            out.delay, out.padding = both >> 12, both & 4095
        out.vbr = kind.decode(), frames, size, points
        return True
    body = at + 36
    if data[body : body + 4] == b"VBRI" and body + 26 <= len(data):
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[body + 10 : body + 24])
        table = data[body + 26 : body + 26 + entries * width]
        steps = [int.from_bytes(table[i : i + width], "big") * scale for i in range(0, len(table), width)] if width else []
        out.vbr = "VBRI", frames, size, np.cumsum(steps, dtype=np.int64).tolist()
        return True
    return False


def restore(data: bytes, stream: Stream) -> bytes:
    """The samples of a stream that ``store`` wrote."""
    n = int(stream.tags["payload_bytes"])
    out = b"".join(data[o + OVERHEAD : o + h.size] for o, h in zip(stream.offsets, stream.headers, strict=True))
    return out[:n]


def feature(samples: bytes, stream: Stream) -> str:
    """Frames, samples and rate, checksum of the seek offsets, damaged frames, and the samples' mean and deviation."""
    a = np.frombuffer(samples, np.uint8)
    seek = zlib.crc32(np.array(stream.offsets, "<u8"))
    return f"frames={len(stream.offsets)};duration={stream.samples}/{stream.rate};seek={seek:08x};bad={stream.bad_crc}/{stream.checked};mean={a.mean():.4f};dev={a.std():.4f}"


# --- operators ------------------------------------------------------------------------------------


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the stored stream) of every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [payload(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([store(s) for _, s in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def parse_audio(media: DataFrame, content: str = "media") -> DataFrame:
    """The rows of ``media`` with an ``audio`` column: tags, information table and its seek points, encoder delay and
    padding, frames, samples and seconds of the sound without these, rate, frame offsets, checksums verified and failed, bytes skipped. Null or empty content, and content without
    any frame, gives a struct of empty values; damaged stretches count as skipped."""
    schema = "tags map<string,string>, vbr_kind string, vbr_frames long, vbr_bytes long, vbr_points array<long>, delay int, padding int, frames long, samples long, rate int, seconds double, offsets array<long>, crc_checked long, crc_failed long, skipped_bytes long"

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for c in columns:
            rows = []
            for data in c:
                s = parse(bytes(data or b""))
                vbr = s.vbr or (None, None, None, None)
                rows.append((s.tags, *vbr, s.delay, s.padding, len(s.offsets), s.samples, s.rate, s.seconds, s.offsets, s.checked, s.bad_crc, s.skipped))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.replace("map<string,string>", "map").split(", ")])

    return media.withColumn("audio", F.pandas_udf(run, schema)(F.col(content)))


def media_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every row.

    Everything but n_bytes is computed from the stored bytes, read back. A null or empty text is 64 zero
    bytes; equal texts have equal values; repeated rows each give a row; an empty table gives no rows; other
    columns are ignored. A row's text and its stream are all that a task adds to a batch.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for n, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                data = data.as_py()
                stream = parse(data)
                back = restore(data, stream)
                out.append((n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), sha256(data).hexdigest(), feature(back, stream)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store_texts(docs, doc_id, text).mapInArrow(run, schema)
