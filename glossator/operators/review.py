"""Documents as paragraphs, passages and context windows; comments anchored to paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossator.functions import text as tx
from glossator.functions.similarity import LOCATE_THRESHOLD, QUOTE_CHARS, covering_paragraph
from glossator.sources.storage import durable

WINDOW_SIZE = 3
CONTEXT_TOKENS = 6000
BACK_JOIN_CHARS = 200
#: Paragraphs of a document that are matched together.
BIN = 64


def reach(window: int) -> tuple[int, int]:
    """Passages before and after the current one that belong to its context."""
    return window + 2, max(1, window - 1)


def paragraph_rows(docs: DataFrame, least: int = tx.MIN_PARAGRAPH) -> DataFrame:
    """doc_id, paragraph_index, text of every paragraph of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(tx.paragraphs(F.col("text"), least)).alias("paragraph_index", "text"))


def passage_rows(docs: DataFrame, target: int = tx.PASSAGE_CHARS, least: int = tx.MIN_PARAGRAPH) -> DataFrame:
    """doc_id, passage_index, paragraph_indices, text of every passage of docs (doc_id, text)."""
    packed = tx.passages(tx.paragraphs(F.col("text"), least), target)
    return docs.select("doc_id", F.posexplode(packed).alias("passage_index", "p")).select("doc_id", "passage_index", "p.paragraph_indices", "p.text")


def with_context(passages: DataFrame, window: int = WINDOW_SIZE, most_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """passages with ``context``: the passages around each, the current one marked, cut to the token budget.

    One sort by document; a frame holds at most 2 * window + 2 passages.
    """
    before, after = reach(window)
    w = Window.partitionBy("doc_id").orderBy("passage_index").rowsBetween(-before, after)
    frame = F.collect_list(F.struct("passage_index", "text")).over(w)
    own = F.col("passage_index")
    shown = F.transform(F.col("_frame"), lambda x: F.concat(F.when(x.passage_index == own, ">>> ").otherwise("    "), F.lit("[section "), x.passage_index.cast("string"), F.lit("] "), x.text))
    whole = F.array_join(shown, "\n\n")
    cut = F.when(tx.token_count(F.col("_whole")) > most_tokens, F.substring(F.col("_whole"), 1, most_tokens * tx.CHARS_PER_TOKEN)).otherwise(F.col("_whole"))
    return passages.withColumn("_frame", frame).withColumn("_whole", whole).withColumn("context", cut).drop("_frame", "_whole")


def review_plan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraphs, passages, doc_tokens and max_summary_tokens (a tenth of the document, 4000 at least)."""
    paras = tx.paragraphs(F.col("text"))
    planned = docs.select("doc_id", paras.alias("p"), tx.token_count(F.col("text")).alias("doc_tokens"))
    return planned.select("doc_id", F.size("p").alias("paragraphs"), F.size(tx.passages(F.col("p"))).alias("passages"), "doc_tokens", F.greatest(F.lit(4000), F.floor(F.col("doc_tokens") / 10)).alias("max_summary_tokens"))


def document_paragraphs(docs: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """doc_id, bin, paragraph_index and para, the normalised text, of every paragraph of the documents (of those with
    comments, if these are given); a bin is 64 paragraphs."""
    needed = docs if comments is None else docs.join(comments.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = paragraph_rows(needed)
    return rows.select("doc_id", F.floor(F.col("paragraph_index") / BIN).cast("int").alias("bin"), "paragraph_index", tx.for_matching(F.col("text")).alias("para"))


def passage_paragraphs(docs: DataFrame, passages: DataFrame, comments: DataFrame) -> DataFrame:
    """doc_id, bin, paragraph_index and para of the documents with comments; a bin is a passage."""
    own = passages.select("doc_id", F.col("passage_index").alias("bin"), F.explode("paragraph_indices").alias("paragraph_index"))
    return document_paragraphs(docs, comments).drop("bin").join(own, ["doc_id", "paragraph_index"]).select("doc_id", "bin", "paragraph_index", "para")


def wanted_quote() -> Column:
    return F.nullif(F.substring(tx.for_matching(F.col("quote")), 1, QUOTE_CHARS), F.lit(""))


def containing(asks: DataFrame, paras: DataFrame, key: list[str], on: list[str]) -> DataFrame:
    """The key of each ask that some paragraph of its bins contains, and the first such paragraph. JVM only; the rows of the
    join are those that match."""
    met = asks.alias("a").join(paras.alias("p"), [F.col(f"a.{c}") == F.col(f"p.{c}") for c in on] + [F.contains(F.col("p.para"), F.col("a._quote"))])
    return met.groupBy(*(F.col(f"a.{c}").alias(c) for c in key)).agg(F.min("p.paragraph_index").alias("_found"))


def anchored(comments: DataFrame, paras: DataFrame, window: int | None = None, threshold: float = LOCATE_THRESHOLD) -> DataFrame:
    """comments (doc_id, quote, ...) with ``paragraph_index``: the first paragraph that contains the normalised
    quote, else the one that covers most of it, null below the threshold. paras: doc_id, bin, paragraph_index, para.

    With a ``window`` comments have a passage_index, bins are passages, and a comment meets those in reach of its own.
    It is a range join: each quote goes to the bins of its range, and meets the paragraphs there. Quotes are looked up
    once however many comments have them. Only those that no paragraph contains go to the matcher, with the paragraphs
    of their range, or, over a whole document, with those of a bin at a time; so no row holds more than that.
    """
    columns = [c for c in comments.columns if c != "paragraph_index"]
    key = ["doc_id", "_quote"] if window is None else ["doc_id", "passage_index", "_quote"]
    rows = comments.select(*columns).withColumn("_quote", wanted_quote())
    asks = rows.where("_quote is not null").select(*key).distinct()
    on, per = ["doc_id"], [*key, "bin"]
    if window is not None:
        before, after = reach(window)
        asks = asks.withColumn("bin", F.explode(F.sequence(F.col("passage_index") - before, F.col("passage_index") + after)))
        on, per = ["doc_id", "bin"], key
    asks = durable(asks)
    exact = durable(containing(asks, paras, key, on))
    if threshold > 1:  # no score, a share of the quote, can reach it
        found = rows.join(exact, key, "left")
        return found.select(*columns, F.col("_found").cast("int").alias("paragraph_index"))
    left = asks.join(exact, key, "left_anti").join(paras, on)
    lists = left.groupBy(*per).agg(F.array_sort(F.collect_list(F.struct("paragraph_index", "para"))).alias("_list"))
    scored = lists.select(*key, "_list", covering_paragraph(F.col("_quote"), F.transform("_list", lambda x: x.para), threshold).alias("_f"))
    scored = scored.where("_f.place is not null").select(*key, F.struct((-F.col("_f.score")).alias("s"), F.element_at("_list", F.col("_f.place") + 1).paragraph_index.alias("i")).alias("_f"))
    fuzzy = scored.groupBy(*key).agg(F.min("_f").alias("_f")).select(*key, F.col("_f.i").alias("_covered"))
    found = rows.join(exact, key, "left").join(fuzzy, key, "left")
    return found.select(*columns, F.coalesce("_found", "_covered").cast("int").alias("paragraph_index"))


def anchor_in_document(comments: DataFrame, docs: DataFrame) -> DataFrame:
    """Anchors over whole documents."""
    return anchored(comments, document_paragraphs(docs, comments))


def anchor_in_window(comments: DataFrame, docs: DataFrame, passages: DataFrame, window: int = WINDOW_SIZE, threshold: float = LOCATE_THRESHOLD) -> DataFrame:
    """Anchors of comments (doc_id, passage_index, quote, ...) over the paragraphs of the passages around each."""
    return anchored(comments, passage_paragraphs(docs, passages, comments), window, threshold)


def exact_anchors(comments: DataFrame, docs: DataFrame) -> DataFrame:
    """comments with the first paragraph that contains the normalised quote, null where none does. JVM only."""
    rows = comments.withColumn("_quote", wanted_quote())
    asks = rows.where("_quote is not null").select("doc_id", "_quote").distinct()
    found = containing(asks, document_paragraphs(docs, comments), ["doc_id", "_quote"], ["doc_id"])
    return rows.join(found, ["doc_id", "_quote"], "left").select(*comments.columns, F.col("_found").cast("int").alias("paragraph_index"))


def back_join(consolidated: DataFrame, originals: DataFrame) -> DataFrame:
    """Consolidated comments with the paragraph of the last original of the same quote where they have none."""
    key = lambda c: F.substring(F.col(c), 1, BACK_JOIN_CHARS)
    last = originals.groupBy("doc_id", key("quote").alias("_key")).agg(F.max(F.struct("ord", "paragraph_index")).alias("_last"))
    rows = consolidated.withColumn("_key", key("quote")).join(last, ["doc_id", "_key"], "left")
    return rows.withColumn("paragraph_index", F.coalesce("paragraph_index", F.col("_last.paragraph_index"))).drop("_key", "_last")
