"""Hard negatives by a two-dimensional block matrix multiply.

Scores are the product of the anchors' matrix with that of all rows, which no task could hold. Rows are dealt over
R shards, anchors over Q, and the dimensions are cut into chunks; cell (q, r) of the grid gets, chunk by chunk, the
panels of anchor shard q and of row shard r, each panel being sent along its side of the grid. The cell multiplies
chunk by chunk and adds the partial scores up in int64 where they are; no score leaves it. Of its tile it has a
slice of anchors at a time, so a task holds two panels and a slice, whatever the table's size.

A cell then gives each anchor's best rows of the same label; the best of all cells are its positives. Their scores
go back with the anchors' panels, the scores are made once more, and each cell gives the best rows of other labels
within the window of each (anchor, positive); these are reduced to the first few. Tiles are made anew because they
grow with anchors times rows: kept, or shuffled to be added up, they outgrow any disk, while panels grow as the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossator.llm.common import durable, spent_shuffles_removed
from glossator.llm.vectors import integers, largest, sound

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative has at least this share of the positive's score, in hundredths, and at most all of it.
LEAST_SHARE = 80
#: Rows of a shard, about, while there are no more than SHARDS of them, then up to WIDER times as many; anchors of a shard;
#: dimensions of a chunk at least, and chunks at most.
ROWS, SHARDS, WIDER, ANCHORS, CHUNK, CHUNKS = 4096, 48, 16, 16384, 32, 4
#: Scores of a cell that are in hand at a time, about.
SLICE = 1 << 20
#: Windows that may be broadcast.
BROADCAST_WINDOWS = 200_000

PIECE = "id long, label long, k int, piece binary"
BEST = "anchor long, id long, score long"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
WINDOWS = "array<struct<id:long,score:long>>"


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, of equal ones the earliest."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T in int64. Products that float64 holds exactly, sums included, are left to it."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def pieces(rows: DataFrame, dims: int, chunks: int, scale: int) -> DataFrame:
    """Each sound row (id, label, v) once for each chunk of its dimensions, as int32."""
    width = -(-dims // chunks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                kept, x = integers(part.column(2), scale, chunks * width, largest(dims, 7))
                at = pa.array(kept)
                for k in range(chunks):
                    own = np.ascontiguousarray(x[:, k * width : (k + 1) * width].astype("<i4"))
                    ends = pa.py_buffer((np.arange(len(own) + 1) * width * 4).astype(np.int32))
                    piece = pa.Array.from_buffers(pa.binary(), len(own), [None, ends, pa.py_buffer(own)])
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(2)), pa.array(np.full(len(own), k, np.int32)), piece], names=["id", "label", "k", "piece"])

    return rows.select("id", "label", "v").mapInArrow(run, PIECE)


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list]:
    """Ids and labels of a panel in order of the ids, its chunks, each in that order, and the windows of its rows."""
    chunks, known = [], None
    for k in np.unique(table.column("k").to_numpy()).tolist():
        own = table.filter(pc.equal(table.column("k"), k))
        ids = own.column("id").to_numpy()
        o = np.argsort(ids, kind="stable")
        known = known or (ids[o], own.column("label").to_numpy()[o], own.column("windows").take(pa.array(o)))
        chunks.append(np.frombuffer(b"".join(own.column("piece").to_pylist()), "<i4").reshape(len(ids), -1)[o])
    return known[0], known[1], chunks, known[2]


def partial_tiles(own: DataFrame, asking: DataFrame, q: int, r: int) -> DataFrame:
    """What the grid's partial products are made of: for each (anchor shard, row shard, chunk) the pieces of the anchors
    and those of the rows."""
    shard = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n)).cast("int")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    panel = ["id", "label", "k", "piece"]
    rows = own.select(*panel, F.lit(False).alias("asks"), F.lit(None).cast(WINDOWS).alias("windows"), shard("id", r, "row").alias("r")).withColumn("q", along(q))
    anchors = asking.select(*panel, F.lit(True).alias("asks"), F.when(F.col("k") == 0, F.col("windows")).alias("windows"), shard("id", q, "anchor").alias("q")).withColumn("r", along(r))
    return rows.unionByName(anchors)


def scores_of(y: list[np.ndarray], x: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of the anchors y with the rows x, a slice of anchors at a time, and where that begins: products of the
    chunks, added up."""
    step = max(1, SLICE // max(1, len(x[0])))
    x = [b.astype(np.int64) for b in x]
    for i in range(0, len(y[0]), step):
        total = None
        for a, b in zip(y, x, strict=True):
            part = product(a[i : i + step].astype(np.int64), b)
            total = part if total is None else np.add(total, part, out=total)
        yield i, total


def panels(cell: pa.Table) -> Iterator[tuple]:
    """Both panels of a cell, anchors first; nothing where it lacks one."""
    asks = cell.column("asks")
    anchors, rows = cell.filter(asks), cell.filter(pc.invert(asks))
    if anchors.num_rows and rows.num_rows:
        yield matrix(anchors), matrix(rows)


def listed(rows: list[tuple], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def tiles(partial: DataFrame, most: int) -> DataFrame:
    """Each anchor's first rows of its label in each cell."""

    def run(cell: pa.Table) -> pa.Table:
        out = []
        for (anchors, anchor_labels, y, _), (ids, labels, x, _) in panels(cell):
            for label in np.unique(anchor_labels).tolist():
                mine, same = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
                if not len(same):
                    continue
                own = ids[same]
                for i, scores in scores_of([a[mine] for a in y], [b[same] for b in x]):
                    for anchor, row in zip(anchors[mine[i : i + len(scores)]].tolist(), scores, strict=True):
                        at = first(row, most + 1)
                        at = at[own[at] != anchor][:most]
                        out += [(anchor, n, s) for n, s in zip(own[at].tolist(), row[at].tolist(), strict=True)]
        return listed(out, BEST)

    return partial.groupBy("q", "r").applyInArrow(run, BEST)


def within(partial: DataFrame, most: int, least_share: int) -> DataFrame:
    """For each window (anchor, positive, score) the first rows of other labels in it of each cell."""

    def run(cell: pa.Table) -> pa.Table:
        out = []
        for (anchors, anchor_labels, y, windows), (ids, labels, x, _) in panels(cell):
            windows = windows.to_pylist()
            for i, scores in scores_of(y, x):
                for anchor, label, told, row in zip(anchors[i : i + len(scores)].tolist(), anchor_labels[i : i + len(scores)].tolist(), windows[i : i + len(scores)], scores, strict=True):
                    if not told:
                        continue
                    # Rows that are in a window of the anchor at all.
                    least = -(-least_share * min(w["score"] for w in told) // 100)
                    near = np.flatnonzero((row >= least) & (row <= max(w["score"] for w in told)))
                    near = near[labels[near] != label]
                    own = row[near]
                    for w in told:
                        at = np.flatnonzero((own <= w["score"]) & (100 * own >= least_share * w["score"]))
                        at = near[at[first(own[at], most)]]
                        out += [(anchor, w["id"], w["score"], n, s) for n, s in zip(ids[at].tolist(), row[at].tolist(), strict=True)]
        return listed(out, FOUND)

    return partial.groupBy("q", "r").applyInArrow(run, FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (``is_anchor``; all
    rows, if none is given) its first ``positives`` other rows of the same label by score, and for each of these the
    first ``negatives`` rows of other labels with ``least_share`` to 100 hundredths of its score.

    Scores are inner products of floor(scale * x); equal ones go by the smaller id. Rows without an id or a label (a
    whole number), and rows whose vector is null or has null, NaN or infinite components, take no part; of rows that
    repeat an id the first by (label, vector) does. Shorter vectors have zeros behind them; scaled components are held
    to a magnitude for which a hundred times a score fits a long (2^24 at 64 dimensions, or 65536 before scaling). An
    anchor without positives, a positive without negatives, and an empty table give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    named = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), named.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_anchor if is_anchor is not None else F.lit(True), F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null").where(sound(F.col("v")))
    known = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("x")).select("id", "x.*")
    n, m, dims = known[0], known[1], max(1, known[2] or 0)
    wide = min(max(ROWS, -(-n // SHARDS)), ROWS * WIDER)
    q, r, chunks = max(1, -(-m // ANCHORS)), max(1, -(-n // wide)), min(CHUNKS, -(-dims // CHUNK))
    cut = lambda x: pieces(x, dims, chunks, scale)
    with spent_shuffles_removed(spark):
        asking = cut(rows.where("anchor"))
        best = tiles(partial_tiles(cut(rows), asking.withColumn("windows", F.lit(None).cast(WINDOWS)), q, r), positives)
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        chosen = durable(best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"))
        windows = chosen.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("windows"))  # a few of each anchor
        windows = F.broadcast(windows) if chosen.count() <= BROADCAST_WINDOWS else windows
        met = partial_tiles(cut(rows), asking.join(windows, asking["id"] == windows["anchor"]).drop("anchor"), q, r)
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        found = within(met, negatives, least_share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        return durable(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def hard_negative_report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; where it is divisible by 7 the label is the next of ten."""
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, vec_id % 100 == 0, label=label)
