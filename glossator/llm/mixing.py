"""Mixing sources to target weights by balanced sampling (the cube method).

Every document of a source is wanted ``target / source size`` times. The whole part of that rate is taken
as it is; its fraction is an inclusion probability. The flight phase moves the probabilities of a pool of
documents along a direction that changes neither their expected words nor their expected number, until one of
them is 0 or 1, and takes in the next one. Of all such directions it takes the one nearest to moving the
pool's largest document alone, so that large documents settle first and small ones make up for them. Blocks
of a source fly on their own, their leftovers fly together, and when there are too few to balance both words and
documents, one constraint after the other is dropped; the last ones of a source land together on the choice that
is off least.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossator.llm.common import WORD, durable, spare_name

MOST = 3
WEIGHTS = (1, 2, 3)
#: Documents to a block, about.
BLOCK = 8192
#: Open fractions in a flight, at most: so many that the others can make up for the largest one.
POOL = 64
BROADCAST_SOURCES = 100_000
#: Units of a source down to which words and documents are balanced, and those that land together.
BOTH, LANDING = 24, 14
#: What a mean document's words off the target weigh in the landing against a document off.
WORDS_WEIGH = 10.0
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- targets --------------------------------------------------------------------------------------


def source_targets(sizes: DataFrame, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and target of each source of ``sizes`` (source, size).

    Sources in order of code points, null last, have the weights in turn and share all words. A target
    stops at ``most`` times its source's size; what is over goes to the others by weight until none is above.
    One row for each source is all that is sorted in one place, and only sums come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    t = durable(totals.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(most)))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        # Those at their cap stay there, for the share of the others only grows.
        held = F.col("weight") * share >= F.col("cap")
        row = t.agg(F.sum(F.when(held, F.col("cap")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))), F.sum(held.cast("int"))).first()
        held_words, free, n = row[0] or 0.0, row[1] or 0.0, row[2] or 0
        if n == capped or not free:
            break
        capped, share = n, (total - held_words) / free
    return t.select("source", "source_size", F.least(F.col("weight") * share, F.col("cap")).alias("target"))


# --- the cube method ------------------------------------------------------------------------------


class Flight:
    """The flight phase of one group: a pool of open fractions between two calls."""

    def __init__(self, rng_seed: int):
        self.rng = np.random.default_rng(rng_seed)
        self.open: list[tuple] = []  # (key, size)
        self.p: list[float] = []

    def add(self, key, size: float, p: float) -> Iterator[tuple]:
        """Takes one unit in; yields the (key, 0 or 1) that this settles."""
        if p <= EPS or p >= 1 - EPS:
            yield key, int(p >= 0.5)
            return
        self.open.append((key, size))
        self.p.append(p)
        while len(self.open) >= POOL:
            yield from self._step()

    def _step(self, both: bool = True) -> Iterator[tuple]:
        """Moves along the direction nearest to the largest unit's own that keeps the sum of p * size and, if
        ``both``, of p."""
        size = np.array([s for _, s in self.open], float)
        p = np.array(self.p)
        u = np.zeros(len(p))
        u[size.argmax()] = 1.0
        if both:
            size -= size.mean()
            u -= u.mean()
        norm = size @ size
        if norm > EPS:
            u -= size * (size @ u / norm)
        if np.abs(u).max() <= EPS:  # the largest cannot move: all sizes but its own are equal
            u = np.zeros(len(p))
            u[np.argsort(size)[:2]] = (1.0, -1.0)
        live = np.abs(u) > EPS
        up = np.where(u > 0, 1 - p, p)[live] / np.abs(u[live])
        down = np.where(u > 0, p, 1 - p)[live] / np.abs(u[live])
        rise, fall = up.min(), down.min()
        p += u * (rise if self.rng.random() * (rise + fall) < fall else -fall)
        done = (p <= EPS) | (p >= 1 - EPS)
        if not done.any():  # rounding: what stopped the step is settled
            done[np.minimum(p, 1 - p).argmin()] = True
        for i in np.flatnonzero(done).tolist():
            yield self.open[i][0], int(p[i] >= 0.5)
        keep = np.flatnonzero(~done).tolist()
        self.open = [self.open[i] for i in keep]
        self.p = p[keep].tolist()

    def land(self) -> Iterator[tuple]:
        """Settles what is left. The flight goes on, balancing words and documents down to BOTH units and words alone
        down to LANDING; of all choices of these the one that is off least is taken, in words by WORDS_WEIGH means and
        in documents together, and of equal ones the likeliest."""
        while len(self.open) > LANDING:
            yield from self._step(len(self.open) > BOTH)
        if self.open:
            size, p = np.array([s for _, s in self.open], float), np.array(self.p)
            choices = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
            words, documents = np.abs(choices @ size - p @ size), np.abs(choices.sum(axis=1) - p.sum())
            off = WORDS_WEIGH * words / max(1.0, size.mean()) + documents
            odds = np.log(np.where(choices, p, 1 - p)).sum(axis=1)
            best = choices[np.lexsort((-odds, np.round(off, 6)))[0]]
            for (key, _), taken in zip(self.open, best.tolist(), strict=True):
                yield key, taken
        self.open, self.p = [], []


def fly(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """One round over rows (source, block, tie, doc_id, size, p); each group of ``keys`` is a flight.

    Adds ``p`` as it is after the round; in the last round the rest lands. Larger documents go first, so
    that what is left over is small. A task streams over its sorted rows and holds one pool.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys, F.desc("size"), "tie", "doc_id", "p")
    columns = ["source", "block", "tie", "doc_id", "size", "p"]
    landing, group = last, list(keys)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flight, at = None, object()
        for batch in batches:
            out = []
            ids = batch["doc_id"].astype("Int64")
            values = zip(batch["source"], batch["block"], batch["tie"], ids, batch["size"], batch["p"], strict=True)
            for source, block, tie, doc, size, p in values:
                now = (source, block) if "block" in group else (source,)
                if now != at:
                    out += rest(flight)
                    flight, at = Flight(abs(int(tie)) & 0x7FFFFFFF), now
                key = (source, block, tie, doc, size)
                out += [(*k, float(v)) for k, v in flight.add(key, float(size), p)]
            yield frame(out)
        yield frame(rest(flight))

    def rest(flight: Flight | None) -> list:
        if flight is None:
            return []
        if landing:
            return [(*k, float(v)) for k, v in flight.land()]
        return [(*key, p) for (key, _), p in zip(flight.open, flight.p, strict=True)]

    def frame(rows: list) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=columns)
        return df.assign(doc_id=pd.array(df["doc_id"], "Int64"))

    return dealt.mapInPandas(run, "source string, block long, tie long, doc_id long, size long, p double")


# --- operators ------------------------------------------------------------------------------------


def mix_sizes(sizes: DataFrame, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """doc_id, source, tie, size, source_size, target and copies of each row of ``sizes`` (doc_id, source, tie, size)."""
    sizes = durable(sizes)
    targets = durable(source_targets(sizes, most, weights))
    counts = sizes.groupBy("source").agg(F.count("*").alias("_n"))
    plan = targets.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", "rate", F.ceil(F.col("_n") / block).alias("_blocks"))
    # A few dozen bytes a source: broadcast up to BROADCAST_SOURCES of them, so that a hot source stays dealt out.
    plan = F.broadcast(plan) if targets.count() <= BROADCAST_SOURCES else plan
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    dealt = F.pmod(F.xxhash64("doc_id", "tie"), F.col("_blocks"))
    open_ = rows.select("source", dealt.alias("block"), "tie", "doc_id", "size", "p")
    settled = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
    final, blocks = None, rows.agg(F.max("_blocks")).first()[0] or 0
    while blocks > 1:  # what POOL leaves of each block flies again, in fewer blocks
        flown = durable(fly(open_, ["source", "block"], last=False))
        final = flown.where(settled) if final is None else final.union(flown.where(settled))
        blocks = -(-blocks * POOL // block)
        open_ = flown.where(~settled).withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(blocks)), F.lit(blocks)))
    last = fly(open_, ["source"], last=True)
    final = last if final is None else final.union(last)
    taken = final.groupBy("doc_id", "tie", "source", "size").agg(F.sort_array(F.collect_list(F.col("p").cast("int"))).alias("extra"))
    # Repeated rows are told apart by their number only.
    keys = ["doc_id", "tie", "source", "size"]
    alike = rows.groupBy(*keys).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"))
    taken = taken.select(*(F.col(k).alias(f"_{k}") for k in keys), "extra")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = alike.join(taken, on, "inner").select(*keys, "source_size", "target", "whole", F.explode("extra").alias("extra"))
    return joined.select(*keys, "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text)).alias("tie"), word_count(F.col(text)).alias("size"))


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every row.

    Every choice hangs on hashes of doc_id and text, so reruns agree however the table is dealt out. Null
    and empty texts have size 0 and are taken at their source's rate like any other; a null source is the
    last one; repeated rows are drawn each on its own; a source without words has target 0; an empty table
    gives no rows; other columns are ignored.
    """
    mixed = mix_sizes(sized(docs, doc_id, text, source), **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it, with all their columns.

    Of rows that repeat doc_id, source and text, each gets the group's copies shared out evenly.
    """
    mixed = mix_sizes(sized(docs, doc_id, text, source), **options)
    keys = ["doc_id", "source", "tie"]
    names = {k: spare_name(docs, f"_mix_{k}") for k in [*keys, "copies", "n", "copy", "row"]}
    plan = mixed.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    plan = plan.select(*(F.col(c).alias(names[c]) for c in [*keys, "copies", "n"])).hint("shuffle_hash")
    values = {"doc_id": F.col(doc_id).cast("long"), "source": F.col(source).cast("string"), "tie": F.xxhash64(F.col(text))}
    out = docs.join(plan, [values[k].eqNullSafe(F.col(names[k])) for k in keys], "inner")
    copies = F.col(names["copies"])
    if plan.where(F.col(names["n"]) > 1).limit(1).count():
        order = F.xxhash64(*(c for c, t in docs.dtypes if not t.startswith(("map", "variant"))))
        w = Window.partitionBy(*(names[k] for k in keys)).orderBy(order)
        out = out.withColumn(names["row"], F.row_number().over(w))
        copies = F.floor(copies / F.col(names["n"])) + (F.col(names["row"]) <= copies % F.col(names["n"])).cast("int")
    repeat = F.array_repeat(F.lit(0), copies.cast("int"))
    return out.withColumn(names["copy"], F.explode(repeat)).select(*(out[c] for c in docs.columns))
