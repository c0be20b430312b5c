"""Line dedup by winnowing over line hashes.

Grams of ``gram`` lines in a row are hashed, and from each window of ``window`` grams the least is selected (the
last of equal ones). Only the positions that some window selects are kept, about two in ``window + 1``. Two equal
runs of ``gram + window - 1`` lines, the guarantee, select the same gram at the same place, so they have a
fingerprint in common.

Positions are joined by their fingerprint, each later one with the first, and the match is extended to the left and
right, line hash by line hash. As far as the two go together, runs of the guarantee that both hold are repeats.
Extension ends ``window - 1`` lines from the fingerprint: what lies beyond has a fingerprint of its own, from which
the walk goes on, so that repeated runs of any length are found whole. Where the walk ends short of a run, the run
may still have occurred elsewhere: the position is joined again, with the first one that shares the fingerprint and
the lines up to and including the one where it parted from the last. That is one line more each time, so there are
``window`` rounds at most, each over the runs that are open. A fingerprint that very many positions have is never
compared in pairs. The lines of runs that occurred before are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import along_salts, durable, spare_name

GRAM, WINDOW = 1, 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def selected(keyed: DataFrame, gram: int, window: int) -> DataFrame:
    """One row for each position that winnowing selects: doc_id, tie, at (its first line), fp (the gram's hash), lefts
    (for each window that selects it, how many of the run's lines lie before ``at``), and before and after, the hashes
    of up to window - 1 lines on either side, the nearest first.

    The arrays are columns of their own and each is used twice, so that none is computed anew for each element.
    """
    reach, spare = gram + window - 1, window - 1
    rows = keyed.select("doc_id", "tie", F.transform("lines", lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= reach)
    line = lambda i: F.element_at("h", i + 1)
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - gram), lambda i: F.xxhash64(*(line(i + k) for k in range(gram))))
    rows = rows.select("doc_id", "tie", "h", grams.alias("g"))
    # The least of each window; of equal hashes the one with the least -k, which is the last.
    least = lambda s: s - F.array_min(F.array(*(F.struct(F.element_at("g", s + k + 1).alias("fp"), F.lit(-k).alias("k")) for k in range(window)))).k
    rows = rows.select("doc_id", "tie", "h", "g", F.transform(F.sequence(F.lit(0), F.size("g") - window), least).alias("chosen"))

    def position(at: Column) -> Column:
        lefts = F.filter(F.array(*map(F.lit, range(window))), lambda e: (e <= at) & F.coalesce(F.get("chosen", at - e) == at, F.lit(False)))
        near = lambda places: F.array_compact(F.array(*(F.get("h", p) for p in places))) if spare else F.array().cast("array<bigint>")
        return F.struct(at.alias("at"), F.element_at("g", at + 1).alias("fp"), lefts.alias("lefts"), near([at - 1 - k for k in range(spare)]).alias("before"), near([at + gram + k for k in range(spare)]).alias("after"))

    return rows.select("doc_id", "tie", F.explode(F.transform(F.array_distinct("chosen"), position)).alias("p")).select("doc_id", "tie", "p.*")


def extension(own: str, other: str, most: int) -> Column:
    """How many lines two positions have in common on a side, from the nearest on."""
    out = F.lit(most)
    for k in reversed(range(most)):
        out = F.when(F.coalesce(F.get(own, F.lit(k)) == F.get(other, F.lit(k)), F.lit(False)), out).otherwise(k)
    return out


def repeated_runs(keyed: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, tie, starts: where, in lines from 0, runs of gram + window - 1 lines begin that occurred before.

    Runs come in order of (doc_id, hash of the text, line), a null doc_id last.
    """
    spare, hits = window - 1, None
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tie", "at")
    rows = durable(selected(keyed, gram, window)).withColumn("path", F.lit(0).cast("long"))
    for k in range(window):
        # Each position with the first that has its fingerprint and, from the second round on, its path of lines.
        met = along_salts(rows, ["fp", "path"], ["doc_id", "tie", "at"], F.struct(place.alias("place"), F.col("before").alias("b"), F.col("after").alias("a")))
        met = met.where(~place.eqNullSafe(F.col("first.place")))
        met = met.withColumn("left", extension("before", "first.b", spare)).withColumn("right", extension("after", "first.a", spare))
        met = met.select("doc_id", "tie", "at", "fp", "before", "after", "left", "right", F.explode("lefts").alias("e"))
        met = durable(met.withColumn("same", (F.col("left") >= F.col("e")) & (F.col("right") >= spare - F.col("e"))))
        found = met.where("same").select("doc_id", "tie", (F.col("at") - F.col("e")).alias("start"))
        hits = found if hits is None else hits.union(found)
        if k < spare:
            # The lines to the left of the run first, then those to the right, up to the one that parted.
            to_left = F.xxhash64("e", F.slice("before", 1, F.col("left") + 1))
            to_right = F.xxhash64("e", F.slice("before", 1, F.col("e")), F.slice("after", 1, F.col("right") + 1))
            path = F.when(F.col("left") < F.col("e"), to_left).otherwise(to_right)
            rows = met.where("not same").select("doc_id", "tie", "at", "fp", F.array("e").alias("lefts"), "before", "after", path.alias("path"))
    return hits.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs with the text that is left, and n_lines and n_removed beside it.

    A run of ``gram + window - 1`` lines or more that occurred before, in an earlier document or earlier in
    the same one, goes; shorter repeats stay. Runs are judged on the input, and may overlap themselves. Lines
    are compared by 64-bit hashes, runs by two of them. Lines end at LF; a null text has no lines and stays
    null; the empty text is one empty line; rows that repeat doc_id and text are one document and all get its
    result; an empty table gives no rows. If docs has columns of those names already, the new ones get a
    longer name. Work is in proportion to the lines, in one long text too.
    """
    reach = gram + window - 1
    total, removed = spare_name(docs, "n_lines"), spare_name(docs, "n_removed")
    tie = F.xxhash64(F.col(text))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), tie.alias("tie"), lines_of(F.col(text)).alias("lines")).where("lines is not null")
    runs = repeated_runs(keyed.dropDuplicates(["doc_id", "tie"]) if has_repeats(docs, doc_id, tie) else keyed, gram, window)
    names = {c: spare_name(docs, f"_gone_{c}") for c in (*runs.columns, "lines", "gaps")}
    starts, lines, gaps = (F.col(names[c]) for c in ("starts", "lines", "gaps"))
    # The lists of starts are hashed, so the texts need no sort.
    runs = runs.select(*(F.col(c).alias(names[c]) for c in runs.columns)).hint("shuffle_hash")
    on = F.col(doc_id).eqNullSafe(F.col(names["doc_id"])) & tie.eqNullSafe(F.col(names["tie"]))
    joined = docs.join(runs, on, "left").withColumn(names["lines"], lines_of(F.col(text)))
    # What lies between the end of one run and the start of the next.
    between = F.zip_with(F.concat(F.array(F.lit(-reach)), starts), F.concat(starts, F.array(F.size(lines))), lambda a, b: F.struct((a + reach).alias("lo"), b.alias("hi")))
    joined = joined.withColumn(names["gaps"], F.filter(between, lambda g: g.hi > g.lo))
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g.lo + 1, g.hi - g.lo))), "\n")
    n = F.when(lines.isNull(), 0).otherwise(F.size(lines))
    left = F.aggregate(gaps, F.lit(0), lambda a, g: a + g.hi - g.lo)
    columns = [F.when(starts.isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, n.alias(total), F.when(starts.isNull(), 0).otherwise(n - left).alias(removed))


def has_repeats(docs: DataFrame, doc_id: str, tie: Column) -> bool:
    return bool(docs.groupBy(F.col(doc_id), tie).count().where("count > 1").limit(1).count())


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left."""
    out = deduplicate_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **options)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
