"""Text as columns: trimming, paragraphs, passages, tokens, titles and slugs. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PARAGRAPH = 100
PASSAGE_CHARS = 8000
LOCAL_PASSAGE_CHARS = 4000
CHARS_PER_TOKEN = 4
TITLE_CHARS = 200
SLUG_CHARS = 80

PASSAGE = "struct<paragraph_indices:array<int>,text:string>"


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def first_line(c: Column) -> Column:
    """The first line that is not blank, trimmed; null where there is none."""
    return F.try_element_at(non_blank(lines(c)), F.lit(1))


def blocks_from_lines(c: Column) -> Column:
    """Raw text with one paragraph a line, as paragraphs that blank lines part."""
    return F.array_join(non_blank(lines(c)), "\n\n")


# --- paragraphs and passages ----------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once however often it is used, within lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs_of(items: Column, size: Callable[[Column], Column], step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Array of (lo, n): runs of neighbouring items, by a walk that knows only the size of the open run.

    ``step(open, own)`` says whether the item starts a new run, the size of its run with it, and whether it ends it. The
    result has the runs that were ended or followed by another (``done``), and the one left open (``rest``). A list that an
    aggregate grows is copied with all its strings at every step; here the runs are written down as one short text.
    """
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("lo"), F.lit(0).alias("open"), F.lit("").alias("out"))
    write = lambda out, lo, i: F.concat(out, lo.cast("string"), F.lit(":"), i.cast("string"), F.lit(","))

    def walk(acc: Column, item: Column) -> Column:
        def with_own(own: Column) -> Column:
            starts, total, ends = step(acc.open, own)
            lo = F.when(starts, acc.i).otherwise(acc.lo)
            before = F.when(starts & (acc.open > 0), write(acc.out, acc.lo, acc.i)).otherwise(acc.out)
            return F.struct((acc.i + 1).alias("i"), F.when(ends, acc.i + 1).otherwise(lo).alias("lo"), F.when(ends, 0).otherwise(total).alias("open"), F.when(ends, write(before, lo, acc.i + 1)).otherwise(before).alias("out"))

        return let(size(item), with_own)

    walked = F.aggregate(items, zero, walk, lambda acc: F.concat(acc.out, F.when(acc.open > 0, write(F.lit("|"), acc.lo, acc.i)).otherwise("|")))
    bounds = lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("lo"), F.split(x, ":")[1].cast("int").alias("hi"))
    listed = lambda t: F.transform(F.filter(F.split(t, ","), lambda x: x != ""), bounds)
    return let(F.split(walked, "\\|"), lambda parts: F.struct(listed(parts[0]).alias("done"), listed(parts[1]).alias("rest")))


def joined_run(items: Column, lo: Column, hi: Column, by: str) -> Column:
    return F.array_join(F.slice(items, lo + 1, hi - lo), by)


def paragraphs(text: Column, least: int = MIN_PARAGRAPH) -> Column:
    """Array of paragraphs. Blank lines part them; one shorter than ``least`` is put before the next one,
    and a short rest after the last one."""

    def step(open_: Column, own: Column) -> tuple[Column, Column, Column]:
        total = F.when(open_ == 0, own).otherwise(open_ + 2 + own)
        return open_ == 0, total, total >= least

    def with_runs(parts: Column, runs: Column) -> Column:
        last = F.size(runs.done)
        rest = F.try_element_at(runs.rest, F.lit(1))
        whole = F.when(rest.isNull() | (last == 0), F.concat(runs.done, runs.rest)).otherwise(F.concat(F.slice(runs.done, F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.struct(F.try_element_at(runs.done, F.lit(-1)).lo.alias("lo"), rest.hi.alias("hi")))))
        return F.transform(whole, lambda r: joined_run(parts, r.lo, r.hi, "\n\n"))

    parts = non_blank(F.split(F.coalesce(text, F.lit("")), "\n\n", -1))
    return let(parts, lambda p: let(runs_of(p, F.length, step), lambda r: with_runs(p, r)))


def passages(paras: Column, target: int = PASSAGE_CHARS) -> Column:
    """Array of (paragraph_indices, text): neighbouring paragraphs packed up to ``target`` characters, the
    separators between the last passage and the new paragraph not counted."""

    def step(open_: Column, own: Column) -> tuple[Column, Column, Column]:
        starts = (open_ == 0) | (open_ + own > target)
        return starts, F.when(starts, own).otherwise(open_ + 2 + own), F.lit(False)

    def passage(p: Column, r: Column) -> Column:
        return F.struct(F.sequence(r.lo, r.hi - 1).alias("paragraph_indices"), joined_run(p, r.lo, r.hi, "\n\n").alias("text"))

    trimmed = F.transform(paras, trim)
    packed = lambda p: let(runs_of(p, F.length, step), lambda r: F.transform(F.concat(r.done, r.rest), lambda x: passage(p, x)))
    return let(trimmed, packed).cast(f"array<{PASSAGE}>")


def packed_lines(text: Column, most: int) -> Column:
    """Array of pieces of at most ``most`` characters, cut at line ends; a longer line is a piece of its own."""

    def step(open_: Column, own: Column) -> tuple[Column, Column, Column]:
        starts = (open_ == 0) | (open_ + own + 1 > most)
        return starts, F.when(starts, own).otherwise(open_ + 1 + own), F.lit(False)

    packed = lambda p: let(runs_of(p, F.length, step), lambda r: F.transform(F.concat(r.done, r.rest), lambda x: joined_run(p, x.lo, x.hi, "\n")))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(let(lines(text), packed))


# --- tokens ---------------------------------------------------------------------------------------


def token_count(c: Column) -> Column:
    """Tokens by the rule of four characters each."""
    return F.floor(F.length(c) / CHARS_PER_TOKEN)


def counted_by(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A token count of one's own, such as a tokenizer's, in the place of token_count; it sees Arrow batches."""

    def counted(c: Column) -> Column:
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for t in texts:
                yield pd.Series([None if x is None else count(x) for x in t], dtype="Int64")

        return F.pandas_udf(run, "long")(c)

    return counted


def truncate_tokens(c: Column, most: Column | int) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.substring(c, F.lit(1), (most * CHARS_PER_TOKEN).cast("int"))


def token_chunks(c: Column, size: int = 6000, overlap: int = 200) -> Column:
    """Array of slices of ``size`` tokens that share ``overlap`` tokens with the one before."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    width, stride = size * CHARS_PER_TOKEN, (size - overlap) * CHARS_PER_TOKEN
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(c, i, F.lit(width)))


# --- titles ---------------------------------------------------------------------------------------


def default_title(text: Column) -> Column:
    """First line that is not blank, without heading marks, 200 characters at most; Untitled if there is none."""
    return F.coalesce(F.substring(F.regexp_replace(first_line(text), r"^#+\s*", ""), 1, TITLE_CHARS), F.lit("Untitled"))


def markdown_title(text: Column) -> Column:
    """The first heading, wherever it stands, bold marks taken off; else the first line."""
    heading = F.try_element_at(F.filter(non_blank(lines(text)), lambda x: F.startswith(x, F.lit("#"))), F.lit(1))
    bare = F.regexp_replace(trim(F.regexp_replace(heading, r"^#+\s*", "")), r"\*\*(.+?)\*\*", "$1")
    return F.coalesce(bare, F.substring(first_line(text), 1, TITLE_CHARS), F.lit(""))


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens, 80 characters at most; null where nothing is left."""
    c = F.regexp_replace(trim(F.lower(name)), r"[^A-Za-z0-9_\s-]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[\s_]+", "-"), "-+", "-")
    c = F.substring(F.regexp_replace(c, "^-|-$", ""), 1, SLUG_CHARS)
    return F.nullif(c, F.lit(""))


# --- matching -------------------------------------------------------------------------------------


def for_matching(c: Column) -> Column:
    """Lower case, table bars and line breaks as spaces, emphasis marks gone, straight apostrophes."""
    c = F.lower(c)
    for mark, value in (("<br>", " "), ("|", " "), ("*", ""), ("_", ""), ("’", "'")):
        c = F.replace(c, F.lit(mark), F.lit(value))
    return squeeze(c)
