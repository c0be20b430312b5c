"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code of length 23 is
perfect: every 23-bit word lies within three bits of exactly one of the 4096 codewords. The keys of a
word are the codewords of the word itself and of its 23 neighbours (six at most); two words that differ
in two bits or fewer have a neighbour, or one of them, in common and so share a key.

If two fingerprints differ in at most two bits, one of the three segments is free of errors, and each of
the other two has at most two. A fingerprint therefore gets, for each choice of the clean segment, that
segment as it is joined with a Golay key of each other segment: 108 keys at most, of 42 or 47 bits.
Fingerprints that share a key meet, and their distance is then computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossator.llm.common import along_salts, durable, lots, small, spare_name, worker_cache
from glossator.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Low bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Buckets of up to so many fingerprints are solved within one task; larger ones leave it fingerprint by fingerprint.
LARGEST_BUCKET = 100_000


# --- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text; zero where there is no word."""
    import xxhash

    of, held, counts, n = xxhash.xxh64_intdigest, [], np.zeros(64, np.int64), 0
    for piece in lots((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + piece.split()
        hashes = np.array([of(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))], "<u8")
        counts += set_bits(hashes)
        n += len(hashes)
        held = words[-(SHINGLE - 1) :]
    if not n and held:  # fewer words than a shingle has: the whole sequence
        n, counts = 1, set_bits(np.array([of(b" ".join(held), SEED)], "<u8"))
    return majority(counts, n)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes of which so many have each bit."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, counted in blocks so that memory stays small."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- Golay keys -----------------------------------------------------------------------------------


def golay_decoder() -> np.ndarray:
    """For every 23-bit word the index (its 12 data bits) of the codeword within three bits of it."""
    cache = worker_cache("simhash")
    if "golay" not in cache:

        def rest(words: np.ndarray) -> np.ndarray:
            words = words.copy()
            for i in range(22, 10, -1):
                words ^= ((words >> i) & 1) * (GENERATOR << (i - 11))
            return words

        bits = 1 << np.arange(23)
        errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
        errors = np.array(errors, np.int64)
        leader = np.zeros(2048, np.int64)
        leader[rest(errors)] = errors  # one error pattern for each of the 2048 remainders: the code is perfect
        parts = (np.arange(i, i + (1 << 18), dtype=np.int64) for i in range(0, 1 << 23, 1 << 18))
        cache["golay"] = np.concatenate([((w ^ leader[rest(w)]) >> 11).astype(np.uint16) for w in parts])
    return cache["golay"]


def golay_keys(words: np.ndarray, width: int = 23) -> np.ndarray:
    """The keys of each word, one row each, padded by repeating; words shorter than 23 bits have zeros above."""
    decoder = golay_decoder()
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])[None, :]
    keys = np.sort(decoder[near], axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = 65535
    keys = np.sort(keys, axis=1)[:, :6]
    return np.where(keys == 65535, keys[:, :1], keys).astype(np.int64)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, key) for every key of every fingerprint; no fingerprint has a key twice."""
    seg = [((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    keys = [golay_keys(s, width) for s, (_, width) in zip(seg, SEGMENTS, strict=True)]
    rows, out = [], []
    for clean in range(3):
        x, y = (i for i in range(3) if i != clean)
        k = (((seg[clean] << 24)[:, None, None] | (keys[x] << 12)[:, :, None] | keys[y][:, None, :]) | (clean << 60)).reshape(len(fp), -1)
        k.sort(axis=1)
        new = np.ones(k.shape, bool)
        new[:, 1:] = k[:, 1:] != k[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        out.append(k[r, c])
    return np.concatenate(rows), np.concatenate(out)


# --- links ----------------------------------------------------------------------------------------


def span(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the distinct fingerprints ``fp`` under a distance of two bits."""
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    if n <= 48:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
        return forest(fp, [(i[near], j[near])])
    # Two bits or fewer apart: a common word within one bit of both.
    near = (fp[:, None] ^ np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)[None, :]).ravel()
    return forest(fp, [equal_runs(near, np.repeat(np.arange(n), 65))])


def equal_runs(values: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in sorted order that have equal values."""
    o = np.argsort(values, kind="stable")
    same = np.flatnonzero(values[o[1:]] == values[o[:-1]])
    return who[o[same]], who[o[same + 1]]


def forest(fp: np.ndarray, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that is not its component's smallest with the smallest one."""
    root = np.arange(len(fp))  # fp is in ascending order
    for a, b in links:
        while len(a):
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not (root[root] == root).all():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def star(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with the smallest one, whatever the distance, for callers that check the texts themselves."""
    return fp[1:], fp[:1].repeat(max(0, len(fp) - 1))


def within_a_bit(open_rows: DataFrame) -> DataFrame:
    """a, b: links between fingerprints (fp) two bits or fewer apart, by way of the words within one bit of them: each
    with the least that has a word in common. As rows, with minima that are combined before the shuffle."""
    words = F.explode(F.array("fp", *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))).alias("word")
    return with_least(open_rows.select("fp").distinct().select("fp", words), "word")


def with_least(rows: DataFrame, key: str) -> DataFrame:
    """a, b: each fp with the least (unsigned, as in ``forest``) that has its key."""
    order = F.struct((F.col("fp") < 0).alias("high"), "fp")
    return along_salts(rows, [key], ["fp"], order).select(F.col("fp").alias("a"), F.col("first.fp").alias("b")).where("a <> b")


def fingerprint_links(distinct: DataFrame, solver: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = span) -> DataFrame:
    """a, b: links between the fingerprints of ``distinct`` (fp long, no repeats) that span the classes of
    those two bits or fewer apart. Linked by transitivity, they say the same as all close pairs would; their
    number is linear in the number of meetings. Another ``solver`` (star) links those that share a key otherwise.

    A task holds the fingerprints of one key at most. Of a key with more than LARGEST_BUCKET it holds none: they are
    passed on as rows, and linked by aggregation and joins.
    """
    most = LARGEST_BUCKET

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 2048):
                r, k = fuzzy_keys(fp[i : i + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[i : i + 2048][r].view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        open_key, size, large = None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            links = []
            if open_key is not None and key[0] != open_key:
                links.append(solve(held))
                held, size, large = [], 0, False
            if len(starts) > 1:  # the first bucket may go on from before, the last may go on
                if large:
                    yield passed(open_key, fp[: ends[0]])
                else:
                    links.append(solve([*held, fp[: ends[0]]]))
                held, size, large = [], 0, False
                inner = np.flatnonzero((ends - starts)[1:-1] > 1) + 1
                links += [solve([fp[starts[i] : ends[i]]]) for i in inner]
            open_key = key[-1]
            held.append(fp[starts[-1] :])
            size += len(held[-1])
            if large or size > most:
                large = True
                for part in held:
                    yield passed(open_key, part)
                held = []
            yield batch(links)
        yield batch([solve(held)] if held else [])

    def solve(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        fp = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return solver(np.unique(fp))

    def passed(key: int, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), key))], names=["a", "b", "key"])

    def batch(links: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in links]) if links else np.empty(0, np.uint64)
        b = np.concatenate([x for _, x in links]) if links else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    met = durable(fuzzy_key_rows(distinct, explode).sortWithinPartitions("key").mapInArrow(meet, "a long, b long, key long"))
    links = met.where("b is not null").select("a", "b")
    large = met.where("b is null").select("key", F.col("a").alias("fp"))
    if large.limit(1).count():
        links = links.union(within_a_bit(large) if solver is span else with_least(large, "key"))
    return links.distinct()


def fuzzy_key_rows(distinct: DataFrame, explode: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """key, fp of every key of every fingerprint, dealt by key.

    A fingerprint is small, its keys are not: they are made by as many tasks as there are partitions. An expression
    deals the fingerprints, for Spark drops a repartition by the column that they are grouped by already.
    """
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp").repartition(n, F.xxhash64("fp"))
    return dealt.mapInArrow(explode, "key long, fp long").repartition(n, "key")


# --- operators ------------------------------------------------------------------------------------


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    Rows whose fingerprints differ in two bits or fewer are linked; component_id is the smallest doc_id
    that links reach, the row's own included. Rows with equal fingerprints are one node of the graph from
    the start, so a group of copies costs one node whatever its size.

    Null and empty texts have fingerprint zero and are linked like any other; a null doc_id is never the
    smallest unless all are null; repeated rows each give a row; an empty table gives no rows; other
    columns are ignored.
    """
    fps = durable(fingerprints(docs, doc_id, text))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    nodes = durable(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that come first in their component by doc_id, with all their columns.

    Rows of one doc_id stand or fall together; of rows that repeat both doc_id and text, one stays. Rows
    without a doc_id stay only where their component has no row with one.
    """
    return keep_first(docs, simhash_components(docs, doc_id, text), doc_id, text)


def keep_first(docs: DataFrame, components: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs whose doc_id is their component_id, once where they repeat doc_id and text."""
    found = durable(components)
    first = found.where("doc_id <=> component_id").select("doc_id").distinct()
    key = spare_name(docs, "_first")
    # The ids are hashed, so the texts need no sort.
    kept = docs.join(first.withColumnRenamed("doc_id", key).hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(doc_id).cast("long")), "left_semi")
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    # Of rows that agree in id and text the one whose hash is least, so that reruns agree.
    number = spare_name(docs, "_number")
    order = [F.xxhash64(*(c for c, t in docs.dtypes if not t.startswith(("map", "variant"))))]
    w = Window.partitionBy(doc_id, text).orderBy(*order)
    return kept.withColumn(number, F.row_number().over(w)).where(F.col(number) == 1).drop(number)
