"""Secret scan with a trigram inverted index. DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived that every matching text
satisfies. One pass over each text takes out those of its trigrams that some query asks for; turned round they
are the index, a table of postings: trigram, document. The queries are answered on that table alone, by
intersecting the postings of each alternative's trigrams and uniting the alternatives. Only candidates are
searched for a rule's expression; rules whose expression has no mandatory trigram search all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of the base scan and their expressions, in their order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """kind, expression, the group whose length counts, its least length, and an equal expression that is
    quicker to search, if there is one. A match that is too short is dropped, but what it covers is used up."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    quick: str | None = None


BASE = (
    Rule("assign", ASSIGN, 2, 6),
    # A run is matched whole or not at all, so asking for its length at once finds the same spans.
    Rule("access", ACCESS, 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", HEX, 0, 24, r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]+@"),
)

# --- trigram queries ------------------------------------------------------------------------------

#: A query is an OR of ANDs of trigrams; None asks nothing.
Query = frozenset | None
#: Alternatives of a piece of an expression beyond which it counts as unknown.
MOST_ALTERNATIVES = 64


def trigram_query(regex: str) -> Query:
    """The trigrams, in lower case, that every match of ``regex`` has: alternatives of sets of trigrams."""
    try:
        from re import _parser as parser  # the standard library's own parse tree
    except ImportError:
        import sre_parse as parser
    runs = list(_strings(list(parser.parse(regex))))
    best: frozenset | None = None
    for options in runs:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in options}
        if not sets or frozenset() in sets:
            continue
        found = frozenset(s for s in sets if not any(t < s for t in sets))
        best = found if best is None else _both(best, found)
    return best


def _both(a: frozenset, b: frozenset) -> frozenset:
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= MOST_ALTERNATIVES else a


def _strings(items: list) -> Iterator[set[str]]:
    """Stretches of the expression, one after another, each as the set of strings that it may be."""
    run: set[str] = {""}
    for op, value in items:
        name = str(op)
        options: set[str] | None = None
        if name == "LITERAL":
            options = {chr(value).lower()}
        elif name == "IN":
            options = _class(value)
        elif name == "SUBPATTERN":
            options = _whole(list(value[3]))
        elif name == "BRANCH":
            parts = [_whole(list(b)) for b in value[1]]
            options = set().union(*parts) if all(p is not None for p in parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            inner = _whole(list(body))
            if inner is not None and str(high) != "MAXREPEAT" and high <= 4:
                options = set()
                for n in range(low, high + 1):
                    now = {""}
                    for _ in range(n):
                        now = {x + y for x in now for y in inner}
                    options |= now
        if options is not None and len(options) * len(run) <= MOST_ALTERNATIVES:
            run = {x + y for x in run for y in options}
        else:
            yield run
            run = options if options is not None and len(options) <= MOST_ALTERNATIVES else {""}
    yield run


def _class(value: list) -> set[str] | None:
    out: set[str] = set()
    for op, v in value:
        if str(op) != "LITERAL":
            return None
        out.add(chr(v).lower())
    return out if len(out) <= 8 else None


def _whole(items: list) -> set[str] | None:
    parts = list(_strings(items))
    return parts[0] if len(parts) == 1 else None


# --- the index ------------------------------------------------------------------------------------


KEY = ["doc_id", "tie"]


def wanted(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({t for r in rules for option in trigram_query(r.regex) or () for t in option})


def trigrams_in(text: Column, trigrams: list[str]) -> Column:
    """Which of the trigrams (in lower case) a text has in any case: one pass, with a look ahead at each place."""
    if not trigrams:
        return F.array().cast("array<string>")
    plain = lambda s: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in s)
    tails: dict[str, list[str]] = {}
    for t in trigrams:
        tails.setdefault(t[0], []).append(plain(t[1:]))
    pattern = "(?=(" + "|".join(f"{plain(head)}(?:{'|'.join(rest)})" for head, rest in tails.items()) + "))"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))


def keyed_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, tie (a hash of the text) and text, a null one empty; rows that agree in all are one document."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("tie"), whole.alias("text"))


def trigram_postings(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: trigram, doc_id and tie (a hash of the text) of each document that has the trigram."""
    return keyed_texts(docs, doc_id, text).select(F.explode(trigrams_in(F.col("text"), wanted(rules))).alias("trigram"), *KEY)


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, tie and rules (one bit a rule) of the documents in the index that satisfy the query of any rule.

    An alternative of a query is an intersection: of its trigrams each has a bit, and a document is in all
    their postings if it has all bits. Bits are united before the shuffle, where a document's postings lie
    together, so a frequent trigram sends no more than any other.
    """
    asked = []
    for i, r in enumerate(rules):
        for k, option in enumerate(sorted(trigram_query(r.regex) or (), key=sorted)):
            if len(option) > 62:
                raise ValueError("an alternative of more than 62 trigrams")
            asked += [(t, i, k, 1 << bit, (1 << len(option)) - 1) for bit, t in enumerate(sorted(option))]
    # One row for each trigram of a rule, so bounded by the rules.
    query = F.broadcast(postings.sparkSession.createDataFrame(asked, "trigram string, rule int, option int, bit long, every long"))
    met = postings.join(query, "trigram").groupBy(*KEY, "rule", "option").agg(F.bit_or("bit").alias("bits"), F.first("every").alias("every"))
    return met.where("bits = every").groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


# --- spans ----------------------------------------------------------------------------------------


SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Matches that are added up one by one; before them whole blocks of so many are.
BLOCK = 128
STEPS = "array<struct<gap:int,n:int,g:int>>"


def steps_of(text: Column, rule: Rule) -> Column:
    """For each match of the rule how much text lies before it, its length, and that of the group that counts.

    Splitting at the matches gives the pieces between them, extracting gives the matches.
    """
    regex = rule.quick or rule.regex
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group)) if rule.group else found
    before = F.transform(F.slice(F.split(text, regex, -1), 1, F.size(found)), F.length)
    both = F.zip_with(found, counted, lambda m, g: F.struct(F.length(m).alias("n"), F.length(g).alias("g")))
    return F.zip_with(both, before, lambda m, gap: F.struct(gap.alias("gap"), m.n.alias("n"), m.g.alias("g"))).cast(STEPS)


def with_spans(rows: DataFrame, steps: dict[str, tuple[int, Rule]]) -> DataFrame:
    """rows with each column of steps as an array of (start, kind's number, end) in code points.

    A list that an aggregate grows is copied at every step, so places are sums of numbers alone: those of whole
    blocks, then those of blocks before, then those within a block. A text of n matches takes about n * BLOCK / 2
    additions. Each stage is a column of its own that the next uses twice, so it is not made anew for each element.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x.gap + x.n)

    def filled(size: Column, each, kind: str) -> Column:
        return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), each)).otherwise(F.array().cast(kind))

    part = lambda c, b: F.slice(c, b * BLOCK + 1, F.lit(BLOCK))
    others = [c for c in rows.columns if c not in steps]
    def sums(c: str) -> Column:
        return filled(F.ceil(F.size(c) / BLOCK).cast("int"), lambda b: total(part(c, b)), "array<int>").alias(f"_sum_{c}")

    def bases(c: str) -> Column:
        before = lambda b: F.aggregate(F.slice(f"_sum_{c}", F.lit(1), b), F.lit(0), lambda a, x: a + x)
        return filled(F.size(f"_sum_{c}"), before, "array<int>").alias(f"_base_{c}")

    rows = rows.select(*others, *steps, *map(sums, steps)).select(*others, *steps, *map(bases, steps))

    def placed(c: str, number: int, rule: Rule) -> Column:
        def block(b: Column) -> Column:
            own = part(c, b)

            def one(x: Column, j: Column) -> Column:
                lo = F.element_at(f"_base_{c}", b + 1) + total(F.slice(c, b * BLOCK + 1, j)) + x.gap
                return F.struct(lo.alias("start"), F.lit(number).alias("kind"), (lo + x.n).alias("end"), (x.g >= rule.least).alias("kept"))

            return F.transform(F.filter(F.transform(own, one), lambda x: x.kept), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))

        return F.flatten(filled(F.size(f"_base_{c}"), block, f"array<{SPANS}>")).cast(SPANS).alias(c)

    return rows.select(*others, *(placed(c, *steps[c]) for c in steps))


def named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.end)), ",")


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: tuple[Rule, ...] = MORE, postings: DataFrame | None = None) -> DataFrame:
    """doc_id and for each kind the spans of its matches in every row of docs, by start.

    ``postings`` is an index that was built before (``trigram_postings`` of the same texts and rules); without one
    it is built here. Base kinds come first. A null text is empty; a null doc_id is carried along; repeated
    rows each give a row; an empty table gives no rows; other columns are ignored. Work is in proportion to
    the text and its matches, in one long text too.
    """
    rules = BASE + more
    rows = keyed_texts(docs, doc_id, text)
    found = candidates(trigram_postings(docs, rules, doc_id, text) if postings is None else postings, rules)
    # Candidates are hashed, so the texts need no sort.
    found = found.select(F.col("doc_id").alias("_doc_id"), F.col("tie").alias("_tie"), "rules").hint("shuffle_hash")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie")), "left")
    steps = []
    for i, r in enumerate(rules):
        candidate = F.lit(True) if trigram_query(r.regex) is None else F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
        steps.append(F.when(candidate & F.col("text").rlike(r.quick or r.regex), steps_of(F.col("text"), r)).otherwise(F.array().cast(STEPS)).alias(r.kind))
    return with_spans(rows.select("doc_id", *steps), {r.kind: (i, r) for i, r in enumerate(rules)})


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    found = secret_spans(docs, doc_id, text, more)
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.concat(*(F.col(r.kind) for r in BASE))
    every = F.concat(*(F.col(r.kind) for r in BASE + more))
    return found.select("doc_id", *counts, F.sha2(named(base, BASE).cast("binary"), 256).alias("base_sha256"), named(every, BASE + more).alias("spans"))
