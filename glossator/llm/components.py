"""Connected components of a graph that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import durable

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of ``edges`` (a long, b long).

    Alternating large-star and small-star rounds: each node's larger neighbours, then its smaller ones,
    are hung on the smallest node that it knows, until every edge leads to a root. A round is joins and
    minima with partial aggregation, so a hub's edges are never gathered in one list; each round is
    checkpointed in the shared folder and only its edge count and a checksum come to the driver.

    Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = durable(e)
    last = None
    for _ in range(MAX_ROUNDS):
        # Large star: to each node the smallest of itself and its neighbours; larger neighbours move there.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours, and the node itself, move to the smallest one.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(low.select("u", F.col("m").alias("v")).union(moved).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
