"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame operations only.

An item with n distinct shingles is in a document if the document has ``need = ceil(threshold * n)`` of them.
Items are partitioned by n. All items of a partition have bottom-k MinHash sketches of one length, the
``n - need + 1`` least hashes: so many that a document without any of them lacks too many shingles to
reach the threshold, however long it is. The search joins the documents' shingles with the sketches alone;
each pair that meets is a candidate, and no true pair is missed, so recall is 1. Candidates are then
verified: of the candidate documents only, the shingles themselves, as words, are counted against the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossator.llm.common import SPACE, durable, spare_name

SHINGLE = 5
THRESHOLD = 0.8
#: Rows that may be broadcast, of sketches, item shingles or candidates; more are joined by shuffling.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, lowered; none of a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def shingles(tokens: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, repeats included; none where there are fewer words."""
    at = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.element_at(tokens, i + k) for k in range(width))))


def sized_shingles(tokens: Column, width: int) -> Column:
    return F.transform(shingles(tokens, width), lambda h: F.struct(F.lit(width).alias("width"), h.alias("hash")))


def shingle_texts(tokens: Column, width: int) -> Column:
    """All runs of ``width`` words, joined by a space, with their hashes."""
    at = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - (width - 1))).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        own = [F.element_at(tokens, i + k) for k in range(width)]
        return F.struct(F.lit(width).alias("width"), F.xxhash64(*own).alias("hash"), F.concat_ws(" ", *own).alias("shingle"))

    return F.transform(at, one)


def item_table(items: DataFrame, item_id: str, text: str, width: int, threshold: float) -> DataFrame:
    """item, width, n, need, hash, shingle, and sketch (whether it is in the item's sketch) of each distinct shingle.

    Items of fewer words than ``width`` are one shingle of the words they have; items without words match nothing.
    """
    named = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    found = shingle_texts(F.col("w"), width)
    for k in range(1, width):
        found = F.when(F.size("w") == k, shingle_texts(F.col("w"), k)).otherwise(found)
    # Repeated rows of an item, and rows of one id with other texts, count as one item with all their shingles.
    rows = named.select("item", F.explode(found).alias("s")).select("item", "s.*").distinct()
    per_item = rows.groupBy("item").agg(F.count("*").alias("n")).withColumn("need", F.ceil(F.col("n") * threshold - 1e-9))
    rows = rows.join(per_item.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item"))).drop("_item")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("hash", "shingle"))
    return rows.select("item", "width", "n", "need", "hash", "shingle", (rank <= F.col("n") - F.col("need") + 1).alias("sketch"))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has so few rows that this is safe."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketch_candidates(docs: DataFrame, table: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, item: each document with each item of whose sketch it has a shingle."""
    sketch = table.where("sketch").select("item", "width", "hash")
    rows, widths = sketch.agg(F.count("*"), F.collect_set("width")).first()
    tokens = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    if widths in ([], [width]):
        own, on = tokens.select("doc_id", F.explode(shingles(F.col("w"), width)).alias("hash")), ["hash"]
    else:
        every = F.flatten(F.array(*(sized_shingles(F.col("w"), k) for k in sorted(widths))))
        own, on = tokens.select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.width", "s.hash"), ["hash", "width"]
    return own.join(sent(sketch, rows), on).select("doc_id", "item").distinct()


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every pair with containment >= threshold.

    Null and empty texts have no shingles and are in no pair; rows of one doc_id count as one document, null
    ids together; either table may be empty; a containment equal to the threshold counts; other columns are
    ignored. Sketches, items and candidates are broadcast up to BROADCAST_ROWS rows each, which are counted
    first; beyond that both sides are shuffled by shingle or document, and AQE splits the skewed ones.
    """
    table = durable(item_table(items, item_id, item_text, width, threshold))
    pairs = durable(sketch_candidates(docs, table, doc_id, text, width))
    n_pairs, n_table, widths = pairs.count(), *table.agg(F.count("*"), F.collect_set("width")).first()
    # Verification reads the candidate documents again, and of these all shingles.
    known = pairs.select(F.col("doc_id").alias("_doc_id")).distinct()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    mine = named.join(sent(known, n_pairs) if n_pairs <= BROADCAST_ROWS else known.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_semi")
    tokens = mine.select("doc_id", words(F.col("text")).alias("w"))
    every = F.flatten(F.array(*(shingle_texts(F.col("w"), k) for k in sorted(widths or [width]))))
    own = tokens.select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.shingle")
    hits = own.join(sent(table.select("item", "n", "need", "shingle"), n_table), "shingle")
    # A repeated hit adds nothing; the first of them is kept before anything is shuffled.
    hits = hits.groupBy("doc_id", "item", "shingle").agg(F.first("n").alias("n"), F.first("need").alias("need"))
    found = hits.groupBy("doc_id", "item").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.count("*").alias("found")).where("found >= need")
    named_pairs = pairs.select(F.col("doc_id").alias("_doc_id"), F.col("item").alias("_item"))
    real = found.join(sent(named_pairs, n_pairs), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("item").eqNullSafe(F.col("_item")), "left_semi")
    return real.select("doc_id", F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), F.col("found").alias("n_found"), (F.col("found") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that contain no item, with all their columns.

    The ids that go are broadcast up to BROADCAST_ROWS of them, which are counted first, and hashed beyond.
    """
    bad = durable(contained_items(docs, items, doc_id, **options).select("doc_id").distinct())
    key = spare_name(docs, "_contaminated")
    named, rows = bad.withColumnRenamed("doc_id", key), bad.count()
    return docs.join(sent(named, rows) if rows <= BROADCAST_ROWS else named.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(key)), "left_anti")
