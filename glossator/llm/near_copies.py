"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First comes SimHash: each text has a fingerprint of its set, fingerprints that share a Golay key meet (all that are
two bits or fewer apart do, and many at three and four), and each text is compared, by its whole set, with the
least that it meets. Texts of that similarity may differ in far more bits, so what fingerprints leave apart is
found by an exact join, to which those that are in one component already are as good as one text.

The join goes by prefixes. Shingles have one order for all texts; of two sets of that similarity, the
first ``n - ceil(0.8 n) + 1`` shingles of either, n being its size, have one in common. Texts that share such
a shingle meet, and the pairs that their sizes and places leave open are compared by their whole sets. The
order puts shingles last that are frequent, counted in all texts, so that common passages seldom bring texts
together; any order gives the same pairs, so the counts decide speed only. Between the two stands a bound: each text
has a small histogram of its shingles' hashes, two sets cannot have more in common than the lesser counts of
all cells add up to, and pairs for which that is too little are settled without their sets.

Meetings are solved in rounds, each over texts that are not in one component yet. First the texts of a bucket
are compared with its first one, then neighbours by size, which joins groups of near copies by a number of
pairs in proportion to their members; then all pairs of a bucket that are still apart. Pairs whose bitmaps
differ in more bits than two similar sets may have shingles of their own never leave a bucket. All rounds
together say the same as all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import durable, give_back, lots, small, spent_shuffles_removed, worker_cache
from glossator.llm.components import connected_components
from glossator.llm.simhash import fingerprint_links, keep_first, majority, set_bits, star

SHINGLE = 5
SEED = 42
#: In how many texts a shingle is frequent.
FREQUENT = 3
#: The most frequent shingles that are sent to all tasks.
SENT = 200_000
#: Shingles that a task counts at a time, and those of a row that it sends.
COUNTED, PIECE = 1 << 20, 256
#: Nodes that may be broadcast, eight bytes each.
BROADCAST_ROWS = 200_000
#: Pairs of a bucket that are in hand at a time.
BLOCK = 1 << 18

Rows = Iterator[pa.RecordBatch]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; of fewer than five words, of the whole sequence."""
    import xxhash

    of, held, parts = xxhash.xxh64_intdigest, [], []
    for piece in lots((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + piece.split()
        parts.append(np.unique(np.array([of(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))], "<u8")))
        held = words[-(SHINGLE - 1) :]
    found = np.unique(np.concatenate(parts))
    return found if len(found) else np.array([of(b" ".join(held), SEED)], "<u8")


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and node (the text's hash, so copies are one node) of every row."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("node"))


def bucket_bits(texts: DataFrame) -> int:
    """How many high bits of a hash name its bucket: some 4 MB of text to a bucket, and several buckets to a task."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max((4 * n).bit_length(), (size >> 22).bit_length())


def tallied(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all arrays, ascending, and the sums of their counts."""
    found, n = np.concatenate(held), np.concatenate(counts)
    o = np.argsort(found)
    found, n = found[o], n[o]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], np.add.reduceat(n, first)


def shingle_counts(texts: DataFrame) -> DataFrame:
    """token and count (in how many texts it is) of every shingle that FREQUENT texts or more have, of all texts. Copies of
    a text count once in each task that meets them.

    Tasks count what they meet, and send it by ranges of hashes as arrays of a few hundred; of each range the sums are made."""
    bits, least = bucket_bits(texts), FREQUENT

    def run(batches: Iterable[pa.RecordBatch]) -> Rows:
        worker_cache("near copies")
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for b in small(batches):
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                held.append(shingle_set(t))
                size += len(held[-1])
                if size >= COUNTED:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)
        give_back()

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = tallied(held, [np.ones(len(own), "<u4") for own in held])
        bucket = (found >> np.uint64(64 - bits)).astype(np.int32)
        starts = np.union1d(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, np.arange(0, len(found), PIECE))
        ends = np.append(starts, len(found)).astype(np.int32)

        def pieces(values: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * values.dtype.itemsize), pa.py_buffer(values)])

        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pieces(found), pieces(n.astype("<u4"))], names=["bucket", "tokens", "counts"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Rows:
        held: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        last = None
        for b in batches:
            for bucket, tokens, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last and held[0]:
                    yield often(*held)
                    held = [], []
                last = bucket
                held[0].append(np.frombuffer(tokens, "<u8"))
                held[1].append(np.frombuffer(counts, "<u4"))
        if held[0]:
            yield often(*held)
        give_back()

    def often(held: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = tallied(held, [c.astype(np.int64) for c in counts])
        return pa.RecordBatch.from_arrays([pa.array(found[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["token", "count"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = texts.select("node", "text").mapInArrow(run, "bucket int, tokens binary, counts binary")
    return parts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(summed, "token long, count long")


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the shingles that are most frequent in all texts, SENT of them at most, and their counts. Of
    shingles with the same count all come or none."""
    counts = durable(shingle_counts(texts))
    # One row for each count that occurs: with n shingles in all there are fewer than sqrt(2 n).
    classes = counts.groupBy("count").agg(F.count("*").alias("tokens")).orderBy(F.desc("count")).collect()
    fit = [r["count"] for r, total in zip(classes, np.cumsum([r.tokens for r in classes])) if total <= SENT]
    found = counts.where(F.col("count") >= (fit[-1] if fit else 1 << 62)).toArrow()
    token, count = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    o = np.argsort(token)
    return token[o], count[o]


def cells(n: int) -> int:
    """How many cells the histogram of a set of n shingles has: a power of two, four shingles a cell at most."""
    return 1 << max(4, (max(1, n) - 1).bit_length() - 2)


def histogram(own: np.ndarray) -> bytes:
    """Of each cell (the hash's low bits) the number of shingles; 255 stands for that many or more."""
    k = cells(len(own))
    return np.minimum(np.bincount((own & np.uint64(k - 1)).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes()


def most_in_common(a: bytes, b: bytes) -> int:
    """An upper bound of the shingles that two sets have in common."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    both_full = np.count_nonzero(x == 255) and np.count_nonzero(y == 255)
    if len(x) != len(y):  # the finer one is folded; low bits stay the same cells
        k = min(len(x), len(y))
        x, y = (v.reshape(-1, k).sum(0, dtype=np.int64) for v in (x, y))
    return 1 << 62 if both_full else int(np.minimum(x, y).sum(dtype=np.int64))


#: Bits of a bitmap, in words of 64.
WORDS = 8


def bitmap(own: np.ndarray) -> bytes:
    """Of each place (a hash's high bits) whether an odd number of shingles has it. Two sets differ in as many places
    at most as they have shingles of their own."""
    counts = np.bincount((own >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


NODE = "node long, n int, prefix array<long>, cells binary, bits binary, fp long"


def node_table(texts: DataFrame) -> DataFrame:
    """node, n (shingles of the text), prefix (the first shingles in their order), cells (the histogram), bits and fp
    (the SimHash fingerprint).

    A task gives each text once; copies in several tasks are sorted out later."""
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts))

    def run(batches: Iterable[pa.RecordBatch]) -> Rows:
        worker_cache("near copies")  # what earlier stages remember is of no use here
        tokens, counts = frequent.value
        seen: set[int] = set()
        for b in small(batches):
            out = []
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                own = shingle_set(t)
                held = histogram(own), bitmap(own), majority(set_bits(own), len(own))
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    own = own[np.argsort(np.where(tokens[at] == own, counts[at], 0), kind="stable")]
                out.append((node, len(own), own[: prefix_size(len(own))].view(np.int64), *held))
            if out:
                node, n, prefix, held, bits, fp = zip(*out, strict=True)
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
                fp = pa.array(np.array(fp, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), lists, pa.array(held, pa.binary()), pa.array(bits, pa.binary()), fp], names=["node", "n", "prefix", "cells", "bits", "fp"])

    return texts.select("node", "text").mapInArrow(run, NODE)


def sketched_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: each node with the least of the nodes that have its fingerprint or one that shares a Golay key with it."""
    one = durable(nodes.select("node", "fp").distinct())
    first = durable(one.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("texts")))
    same = one.join(hinted(first.where("texts > 1").select("fp", "low")), "fp").where("node <> low").select("low", "node")
    links = durable(fingerprint_links(first.select("fp"), star))
    ends = hinted(durable(links.select(F.col("a").alias("fp")).union(links.select("b")).distinct().join(first, "fp").select("fp", "low")))
    met = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(met).toDF("a", "b").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def hinted(rows: DataFrame) -> DataFrame:
    """For a join: sent to all tasks if there are few of them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows with root, the least node of their node's component, the node itself if it is alone."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(hinted(roots), "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))


def prefixes(nodes: DataFrame) -> DataFrame:
    """token, node, n, pos (the token's place in its order) and root of every prefix."""
    return nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"), "root").select("token", "node", "n", "pos", "root")


def words_of(bits: pa.Array) -> np.ndarray:
    """Bitmaps as rows of 64-bit words."""
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, WORDS)


def by_bucket(rows: DataFrame, solve: Callable[[list[np.ndarray]], list[np.ndarray] | Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """What ``solve`` yields for the columns of each token's rows, which come by node."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Rows:
        worker_cache("near copies")
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [words_of(c) if pa.types.is_binary(c.type) else c.to_numpy() for c in b.columns]
            starts = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), b.num_rows]
            out: list[list[np.ndarray]] = []
            if held and held[0][0][0] != cols[0][0]:
                yield from batch(solved(held))
                held = []
            for i, j in zip(starts, starts[1:]):
                part = [c[i:j] for c in cols]
                if j == b.num_rows:
                    held.append(part)
                elif held:
                    yield from batch(solved([*held, part]))
                    held = []
                elif j - i > 1:
                    out += solved([part])
            yield from batch(out)
        if held:
            yield from batch(solved(held))
        give_back()

    def solved(parts: list[list[np.ndarray]]) -> Iterable[list[np.ndarray]]:
        cols = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts, strict=True)]
        new = np.concatenate([[True], cols[1][1:] != cols[1][:-1]])
        return solve([c[new] for c in cols]) if new.sum() > 1 else ()

    def batch(found: Iterable[list[np.ndarray]]) -> Rows:
        found = iter(found)
        while part := [x for _, x in zip(range(4096), found)]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*part, strict=True)], names=names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "token").sortWithinPartitions("token", "node").mapInArrow(run, schema)


def open_pairs(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Those of the pairs i, j of rows (token, node, n, pos, root, bits) that are in different components and can still
    be similar, as nodes: what lies behind the common shingle is enough, and their bitmaps differ in no more places than
    similar sets may."""
    _, node, n, pos, root, bits = cols
    keep = (9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])) & (root[i] != root[j])
    i, j = i[keep], j[keep]
    apart = np.zeros(len(i), np.int64)
    for w in range(WORDS):
        apart += np.bitwise_count(bits[i, w] ^ bits[j, w])
    keep = 9 * apart <= n[i] + n[j]
    x, y = node[i[keep]], node[j[keep]]
    return [np.minimum(x, y), np.maximum(x, y)]


def apart(cols: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The rows of a bucket whose roots (the last column) differ."""
    return [] if (cols[-1] == cols[-1][0]).all() else [cols]


def with_first(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Pairs with the first by hash."""
    yield open_pairs(cols, np.zeros(len(cols[0]) - 1, np.int64), np.arange(1, len(cols[0])))


def neighbours(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Pairs next to each other by size."""
    o = np.lexsort((cols[1], cols[2]))
    yield open_pairs(cols, o[:-1], o[1:])


def cross_pairs(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """All pairs that are open."""
    o = np.lexsort((cols[1], cols[2]))
    size = cols[2][o].astype(np.int64)
    ends = np.searchsorted(size * 4, size * 5, "right")  # the larger set has five fourths at most
    i = 0
    while i < len(size):
        reach = np.cumsum(ends[i:] - np.arange(i, len(size)) - 1)
        k = max(1, int(np.searchsorted(reach, BLOCK, "right")))
        span = ends[i : i + k] - np.arange(i, i + k) - 1
        left = np.repeat(np.arange(i, i + k), span)
        right = np.arange(len(left)) - np.repeat(np.cumsum(span) - span, span) + left + 1
        yield open_pairs(cols, o[left], o[right])
        i += k


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b whose histograms leave a similarity of 0.8 or more open."""
    one = nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("cells").alias("cells"))
    both = pairs.join(one.toDF("a", "n", "x"), "a").join(one.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Rows:
        for b in small(batches):
            need = 4 * (b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy())
            most = np.array([most_in_common(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            keep = pa.array(most >= -(-need // 9))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def whole_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and set (the hashes of its shingles) of the given nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Rows:
        for b in small(batches, 256):
            sets = pa.array([shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["node", "set"])

    few = nodes.count() <= BROADCAST_ROWS
    one = texts.select("node", "text").join(F.broadcast(nodes) if few else nodes.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])
    return one.mapInArrow(run, "node long, set array<long>")


def similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b with a similarity of 0.8 or more: bounded first, what is left compared by whole sets."""
    pairs = durable(possible(pairs, nodes))
    named = durable(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = durable(whole_sets(texts, named))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return durable(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def near_copy_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links of near copies reach, of every row of docs.

    Words are runs of anything but ASCII white space, their ASCII letters made small. Null texts count as
    empty; texts without words are copies of each other; a null doc_id is never the smallest unless all are
    null; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
    """
    texts = keyed(docs, doc_id, text)
    with spent_shuffles_removed(docs.sparkSession):
        table = durable(node_table(texts))
        links = similar(sketched_pairs(table), texts, table)
        roots = durable(connected_components(links)) if links.limit(1).count() else None
        rows = "token long, node long, n int, pos int, root long"
        met = durable(by_bucket(prefixes(with_roots(table.select("node", "n", "prefix"), roots)), apart, rows))
        bits = table.groupBy("node").agg(F.first("bits").alias("bits"))
        for solve in (with_first, neighbours, cross_pairs):
            pairs = by_bucket(met.join(bits, "node").select(*met.columns, "bits"), solve, "a long, b long")
            # In the first round a text is compared with one other only, the least it meets; later rounds see to the rest.
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if solve is with_first else pairs.distinct()
            found = similar(pairs, texts, table)
            if found.limit(1).count():
                links = found if roots is None else found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
                roots = durable(connected_components(links))
                if solve is not cross_pairs:
                    met = durable(by_bucket(with_roots(met.drop("root"), roots), apart, rows))
        roots = durable(connected_components(links)) if roots is None else roots
        nodes = texts.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
        nodes = durable(nodes)
    named = nodes.join(nodes.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return texts.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that come first in their component of near copies by doc_id, with all their columns.

    Rows of one doc_id stand or fall together; of rows that repeat both doc_id and text, one stays. Rows
    without a doc_id stay only where their component has no row with one.
    """
    return keep_first(docs, near_copy_components(docs, doc_id, text), doc_id, text)
