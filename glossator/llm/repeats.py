"""Removal of every byte covered by a long string that also starts elsewhere.

A suffix array of all bytes answers this by comparing neighbours, but sorting one suffix a byte moves tens
of bytes for each byte of text. Here only the suffixes at anchors are compared, an anchor being the place in
a window of ``length`` bytes where the hash of the next ``gram`` bytes is least. Like a difference cover,
anchors meet at equal distances in equal strings: two equal windows have their anchors at the same offset.
They depend on the content only, and about one byte in seventy is one.

Windows in a row with one anchor are a segment. A segment has the anchor's gram, by which equal windows
meet, and the hash of all that its windows cover. The segments of a gram are sorted by that hash and
neighbours compared: equal ones are repeats as a whole; one whose gram alone is elsewhere may share some
windows, and these are compared one by one. A gram that is nowhere else settles all its windows.

Strings are compared by hashes of 64 bits, and only within one gram (its own 64 bits): two strings are taken
for equal by mistake with a chance of 2^-64 for each pair of different segments of one gram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import durable, small, worker_cache

LENGTH = 200
GRAM = 64
#: Texts are hashed together in blocks of about so many bytes; longer texts are cut with overlap.
BLOCK = 1 << 18
#: Segments of one gram that are compared in one go; more are compared offset by offset.
TOGETHER = 4096
#: Repeats that a task remembers having sent on, at most.
REMEMBERED = 1 << 17
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


# --- hashing --------------------------------------------------------------------------------------


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    cache = worker_cache("repeats")
    if len(cache.get("powers", ((),))[0]) < n:
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p, done = np.ones(n, np.uint64), 1
            while done < n:
                more = min(done, n - done)
                p[done : done + more] = p[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more
            both.append(p)
        cache["powers"] = tuple(both)
    return cache["powers"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Hashes of all substrings of a run of bytes in constant time each."""

    def __init__(self, data: bytes | np.ndarray):
        b = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        power, self.inverse = powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``."""
    m, s = x, 1
    while 2 * s <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return m if s == width else np.minimum(m[: len(x) - width + 1], m[width - s :])


# --- segments -------------------------------------------------------------------------------------


def segments(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Of texts laid end to end: gram hash, content hash, and anchor, first window's start and last window's start."""
    n = len(data)
    if n < length:
        return None
    hashed = Hashed(data)
    grams = hashed.all(gram)
    # The least gram of each window; of equal ones the first. 40 bits of hash, then 24 of place.
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (least((grams & np.uint64(MASK ^ 0xFFFFFF)) | place, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return None
    a = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    lo, hi, a = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], a[new]
    shape = ((a - lo) * 65536 + (hi - lo)).astype(np.uint64)
    return grams[a], mixed(hashed.of(lo, hi + length) ^ (shape * np.uint64(BASE))), a, lo, hi


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts in blocks: bytes, end of each piece, its text's number and its offset in that text."""
    piece, number, offset, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), BLOCK):
            p = t[at : at + BLOCK + length - 1]
            piece.append(p)
            number.append(k)
            offset.append(at)
            size += len(p)
            if size >= BLOCK:
                yield b"".join(piece), np.cumsum([len(p) for p in piece]), np.array(number), np.array(offset)
                piece, number, offset, size = [], [], [], 0
    if piece:
        yield b"".join(piece), np.cumsum([len(p) for p in piece]), np.array(number), np.array(offset)


def utf8(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


# A segment's place is one long: first window's start, number of windows (12 bits), offset of the anchor (12 bits).
# Its state: 0, known to be a repeat and of no further use; 1, to be judged; 2, known to be a repeat and to be
# judged for the others.
SEGMENT = "gram long, content long, doc_id long, tie long, place long, state byte"
KEY = ["doc_id", "tie"]


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)


def segment_rows(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """All segments of the texts of ``keyed`` (doc_id, tie, text).

    Equal segments of a block are combined before anything is shuffled: one of them stands for all, and the
    others are dealt out anywhere. A task remembers the repeats that it found so, and sends no further one on:
    a content that is in most blocks costs its gram a row a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.empty(0, np.uint64)  # hashes of gram and content
        for b in small(batches):
            for data, ends, number, offset in blocks(utf8(b.column(2)), length):
                found = segments(data, ends, length, gram)
                if found is None:
                    continue
                g, c, a, lo, hi = found
                k = np.searchsorted(ends, lo, "right")
                start = lo - np.concatenate([[0], ends[:-1]])[k] + offset[k]
                who = pa.array(number[k])
                state = np.ones(len(g), np.int8)
                o = np.lexsort((c, g))
                again = np.zeros(len(g) + 1, bool)  # equal to the one before, in this order
                again[1:-1] = (g[o[1:]] == g[o[:-1]]) & (c[o[1:]] == c[o[:-1]])
                state[o[again[1:]]] = 2
                state[o[again[:-1]]] = 0
                both = mixed(c ^ (g * np.uint64(BASE)))
                if len(sent):
                    state[sent[np.minimum(np.searchsorted(sent, both), len(sent) - 1)] == both] = 0
                if len(sent) < REMEMBERED and (state == 2).any():
                    sent = np.union1d(sent, both[state == 2])
                anywhere = mixed(c + (start.astype(np.uint64) + who.to_numpy().astype(np.uint64) * np.uint64(BASE)))
                g = np.where(state == 0, anywhere, g)
                yield batch_of(SEGMENT, g.view(np.int64), c.view(np.int64), b.column(0).take(who), b.column(1).take(who), start << 24 | (hi - lo + 1) << 12 | (a - lo), state)

    return keyed.mapInArrow(run, SEGMENT)


def classified(rows: DataFrame) -> DataFrame:
    """Of segments, sorted by gram and content, those that matter. Kind 0: its content is elsewhere too, so all
    its windows are repeats. Kind 1: to be compared with others of its gram, being alone with its content,
    or the first or last of equal ones that stand beside other contents.

    Each row is judged by the rows above and below; from batch to batch two rows are held.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "gram").sortWithinPartitions("gram", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last two rows; the lower one is not judged yet
        fresh = True
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                yield from judge(t, 0 if fresh else 1, t.num_rows - 1)
                fresh = fresh and t.num_rows < 2
                held = t.slice(max(0, t.num_rows - 2))
        if held is not None:
            yield from judge(held, held.num_rows - 1, held.num_rows)

    def judge(t: pa.Table, start: int, end: int) -> Iterator[pa.RecordBatch]:
        g, c = t.column(0).to_numpy(), t.column(1).to_numpy()
        same, equal = np.zeros(len(g) + 1, bool), np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        equal[1:-1] = same[1:-1] & (c[1:] == c[:-1])
        up, eq_up, down, eq_down = same[:-1], equal[:-1], same[1:], equal[1:]
        whole = eq_up | eq_down | (t.column(5).to_numpy() != 1)
        beside = (up & ~eq_up) | (down & ~eq_down)
        for kind, found in ((0, whole), (1, beside)):
            pick = np.flatnonzero(found[start:end]) + start
            if len(pick):
                took = t.take(pa.array(pick)).combine_chunks()
                yield batch_of(f"kind byte, {SEGMENT}", np.full(len(pick), kind, np.int8), *(x.chunk(0) for x in took.columns))

    return dealt.mapInArrow(run, f"kind byte, {SEGMENT}").drop("content", "state")


# --- segments that are alike in part --------------------------------------------------------------


def by_document(rows: DataFrame, value: Column) -> DataFrame:
    """One row for each document with the list of its values; as long as the document allows."""
    return rows.groupBy(*KEY).agg(F.collect_list(value).alias("found")).select(F.col("doc_id").alias("_doc_id"), F.col("tie").alias("_tie"), "found")


def with_found(keyed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts with their lists; the lists are hashed, the texts need no sort."""
    on = keyed["doc_id"].eqNullSafe(found["_doc_id"]) & keyed["tie"].eqNullSafe(found["_tie"])
    return keyed.join(found.hint("shuffle_hash"), on, how).select("doc_id", "tie", "text", "found")


PIECE = f"hot boolean, {SEGMENT}, bytes binary"


def pieces(keyed: DataFrame, mixed_rows: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of each segment cover. Of hot grams each window comes as a segment of its own,
    its hash as the gram, for they are too many to be held together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = utf8(b.column(2))
            cold, warm = [], []
            for k, (text, found) in enumerate(zip(texts, b.column(3).to_pylist(), strict=True)):
                for f in found:
                    start, n = f["place"] >> 24, (f["place"] >> 12) & 4095
                    (warm if f["hot"] else cold).append((k, f["gram"], f["place"], text[start : start + n - 1 + length]))
            if cold:
                k, g, p, data = zip(*cold, strict=True)
                who = pa.array(k)
                yield batch_of(PIECE, pa.array([False] * len(k)), pa.array(g), pa.array([0] * len(k)), b.column(0).take(who), b.column(1).take(who), pa.array(p), np.ones(len(k), np.int8), pa.array(data, pa.binary()))
            for k, g, p, data in warm:
                h = Hashed(data).all(length)
                at = (p >> 24) + np.arange(len(h))
                off = (p & 4095) - np.arange(len(h))
                one = mixed(h ^ (np.uint64(g & MASK) + off.astype(np.uint64) * np.uint64(BASE)))
                who = pa.array(np.full(len(h), k))
                yield batch_of(PIECE, pa.array(np.ones(len(h), bool)), one.view(np.int64), h.view(np.int64), b.column(0).take(who), b.column(1).take(who), at << 24 | 1 << 12, np.ones(len(h), np.int8), pa.nulls(len(h), pa.binary()))

    found = by_document(mixed_rows, F.struct("gram", "place", "hot"))
    return with_found(keyed, found, "inner").mapInArrow(run, PIECE)


def compared(cold: DataFrame, length: int) -> DataFrame:
    """kind 0 rows for the windows that segments of one gram share."""
    n = int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cold.select("gram", *KEY, "place", "bytes").repartition(n, "gram").sortWithinPartitions("gram")
    out_schema = "doc_id long, tie long, lo long, hi long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            g = t.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != g[0]:
                yield from shared(pa.concat_tables(held))
                held = []
            cut = int(np.searchsorted(g, g[-1], "left")) if (g[1:] >= g[:-1]).all() else len(g) - int(np.argmax((g != g[-1])[::-1]))
            if cut:
                yield from shared(pa.concat_tables([*held, t.slice(0, cut)]))
                held = []
            held.append(t.slice(cut))
        if held:
            yield from shared(pa.concat_tables(held))

    def shared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        g, place = t.column(0).to_numpy().view(np.uint64), t.column(3).to_numpy()
        count, off = (place >> 12) & 4095, place & 4095
        widest = int(off.max()) + 1
        step = max(1, widest * TOGETHER // max(TOGETHER, t.num_rows))
        for low in range(0, widest, step):  # windows whose anchor lies low to low + step - 1 bytes in
            first, last = np.maximum(0, off - (low + step - 1)), np.minimum(count - 1, off - low)
            many = np.maximum(0, last - first + 1)
            row = np.repeat(np.arange(len(g)), many)
            if not len(row):
                continue
            j = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            h = np.concatenate([window_hashes(t, i, row, j) for i in range(0, t.num_rows, TOGETHER // 4)])
            key = mixed(h ^ (g[row] + (off[row] - j).astype(np.uint64) * np.uint64(BASE)))
            o = np.argsort(key, kind="stable")
            same = key[o[1:]] == key[o[:-1]]
            hit = np.zeros(len(key), bool)
            hit[o[1:][same]] = True
            hit[o[:-1][same]] = True
            h = np.flatnonzero(hit)
            if not len(h):
                continue
            new = np.flatnonzero(np.concatenate([[True], (row[h[1:]] != row[h[:-1]]) | (j[h[1:]] != j[h[:-1]] + 1)]))
            end = np.concatenate([new[1:], [len(h)]]) - 1
            who = pa.array(row[h[new]])
            lo = (place[row[h[new]]] >> 24) + j[h[new]]
            yield batch_of(out_schema, *(t.column(i).take(who).combine_chunks() for i in (1, 2)), lo, lo + (j[h[end]] - j[h[new]]) + length)

    def window_hashes(t: pa.Table, i: int, row: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the windows that lie in a lot of segments from the i-th on; few bytes are hashed together."""
        data = t.column(4).slice(i, TOGETHER // 4).to_pylist()
        start = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        mine = slice(*np.searchsorted(row, (i, i + len(data))).tolist())
        w = start[row[mine] - i] + j[mine]
        return Hashed(b"".join(data)).of(w, w + length)

    return dealt.mapInArrow(run, out_schema)


# --- operators ------------------------------------------------------------------------------------


def keyed_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tie"), F.col(text).cast("string").alias("text"))


def repeated_ranges(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 20_000) -> DataFrame:
    """doc_id, tie, lo, hi: byte ranges (they may overlap) that make up all bytes covered by a string of
    ``length`` bytes that starts elsewhere too. ``hot``: grams in more segments are compared by sorting
    windows instead of in memory; the result is the same."""
    kinds = durable(classified(segment_rows(keyed, length, gram)))
    span = [*KEY, F.shiftright("place", 24).alias("lo"), (F.shiftright("place", 24) + F.shiftright("place", 12).bitwiseAND(F.lit(4095)) - 1 + length).alias("hi")]
    ranges = kinds.where("kind = 0").select(*span)
    part = kinds.where("kind = 1")
    many = part.groupBy("gram").count().where(F.col("count") > hot)
    any_hot = bool(many.limit(1).count())
    flag = F.lit(False)
    if any_hot:
        part = part.join(many.select(F.col("gram").alias("_gram")), F.col("gram") == F.col("_gram"), "left")
        flag = F.col("_gram").isNotNull()
    cut = pieces(keyed, part.select("gram", *KEY, "place", flag.alias("hot")), length)
    if any_hot:
        cut = durable(cut)
        windows = classified(cut.where("hot").select("gram", "content", *KEY, "place", "state"))
        ranges = ranges.union(windows.where("kind = 0").select(*span))
    return ranges.union(compared(cut.where("not hot"), length))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every row of docs.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
    another, goes; strings may overlap and are judged on the input. Windows never cross texts.

    A null text is empty; texts shorter than ``length`` stay; a row repeated whole is a copy, so both lose
    all that is long enough; a null doc_id is carried along; an empty table gives no rows; other columns
    are ignored. ``gram`` must be less than ``length``, and ``length - gram`` less than 4095.
    """
    keyed = keyed_texts(docs, doc_id, text)
    ranges = repeated_ranges(keyed, length, gram, hot)
    found = by_document(ranges, F.struct("lo", "hi"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for data, spans in zip(utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > at or not n:
                        kept.append(data[at:lo])
                        n += 1
                    at = max(at, hi)
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), n, rest))
            yield batch_of("doc_id, n_bytes, n_removed, n_spans, kept", b.column(0), *map(list, zip(*out, strict=True))) if out else batch_of("doc_id, n_bytes, n_removed, n_spans, kept", b.column(0), *([pa.array([], pa.int64())] * 3), pa.array([], pa.binary()))

    return with_found(keyed, found, "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_digest(docs: DataFrame, **options) -> DataFrame:
    """remove_repeats with the SHA-256 of the remaining bytes in their stead."""
    out = remove_repeats(docs, **options)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
