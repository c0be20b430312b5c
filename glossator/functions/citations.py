"""Citations as columns: identifiers, names, years, headings, entry shapes and in-text numbers."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossator.functions.text import let, lines, squeeze, trim

# Headings of a bibliography, as they read without marks and accents.
SECTION_KEYWORDS = ("references", "reference", "referencescited", "bibliography", "workscited", "literaturecited", "bibliographie", "bibliografia", "referencias", "literaturverzeichnis", "参考文献")
# What lines of a bibliography look like.
ENTRY_PATTERNS = (
    r"(?<![A-Za-z0-9_])(1[89]|20)\d{2}[a-z]?(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])doi(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])arxiv(?![A-Za-z0-9_])|https?://",
    r"^\s*\[\d{1,3}\]",
    r"(?i)(?<![A-Za-z0-9_])(?:vol|no|pp?)\.\s*\d|\d+\(\d+\)",
    r"[A-Z][\p{L}'-]+,\s*(?:[A-Z]\.\s*)+",
)
APPENDIX = r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?(?:appendix|appendices|supplementary)(?![A-Za-z0-9_])"
CITATION = "\\[(\\d{1,3}(?:\\s*[,;–—-]\\s*\\d{1,3})*)\\]"
MAX_RANGE = 50
#: The marks that are taken off letters.
MARKS = re.compile("[\u0300-\u036f]")


@cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition, marks taken off, is one other character, these characters, and those of
    which it is several letters or digits of ASCII. By Unicode's own tables; decompositions into several characters of
    which none is such (CJK compounds, Hangul syllables) are left out, for titles keep none of them."""
    one, other, several = [], [], {}
    for i in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):
        plain = MARKS.sub("", unicodedata.normalize("NFKD", chr(i)))
        if len(plain) == 1 and plain != chr(i):
            one.append(chr(i))
            other.append(plain)
        elif len(plain) > 1 and re.search("[a-z0-9]", plain):
            several[chr(i)] = plain
    return "".join(one), "".join(other), several


def ranges(chars: str) -> str:
    """A class of an expression for these characters, which ascend, by ranges: long lists of single ones are slow."""
    runs: list[list[int]] = []
    for i in map(ord, chars):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def without_accents(c: Column) -> Column:
    """Letters without their marks, full-width, mathematical, raised and lowered forms, ligatures and the like as the plain
    characters that they stand for."""
    one, other, several = decompositions()
    keys, values = "".join(several), list(several.values())
    found = lambda x: F.try_element_at(F.lit(values), F.nullif(F.instr(F.lit(keys), x), F.lit(0)))
    spelt = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(found(x), x)), "")
    plain = F.translate(F.when(c.rlike(ranges(keys)), spelt).otherwise(c), one, other)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(plain, r"[\x{0300}-\x{036f}]", "")).otherwise(c)


def normal_title(c: Column) -> Column:
    """Lower case, no accents, no LaTeX commands, letters and digits only, single spaces."""
    c = F.regexp_replace(without_accents(F.lower(c)), r"\\[a-zA-Z]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[{}$]", ""), "[^a-z0-9 ]+", " ")
    return squeeze(c)


def normal_doi(c: Column) -> Column:
    """Lower case, no resolver, no prefix, no white space; null for what is no DOI."""
    d = F.regexp_replace(trim(c), r"(?i)^https?://(dx\.)?doi\.org/", "")
    d = F.lower(F.regexp_replace(F.regexp_replace(d, r"(?i)^doi:\s*", ""), r"(?U)\s+", ""))
    return F.when(F.startswith(d, F.lit("10.")), d)


def arxiv_id_of_doi(c: Column) -> Column:
    return F.nullif(F.regexp_extract(normal_doi(c), r"^10\.48550/arxiv\.(.+)$", 1), F.lit(""))


def normal_arxiv_id(c: Column) -> Column:
    """Without prefix and version; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(trim(c), r"(?i)^arxiv:\s*", ""), r"(?i)v\d+$", ""), F.lit(""))


def family_name(author: Column) -> Column:
    """Last word of more than one letter, of what stands before a comma; lower case, no accents."""
    a = trim(F.regexp_replace(author, r"(?i)(?<![A-Za-z0-9_])et al\.?", ""))
    base = F.when(F.instr(a, ",") > 1, F.substring_index(a, ",", 1)).otherwise(a)
    words = F.filter(F.transform(F.split(base, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}'-]", "")), lambda w: F.length(w) > 1)
    return without_accents(F.lower(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))))


def family_names(authors: Column) -> Column:
    return F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), family_name), lambda x: x != "")


def author_overlap(cited: Column, found: Column) -> Column:
    """Share of the cited family names, repeats counted, that the record has too; 0 if none is cited."""
    return name_overlap(family_names(cited), family_names(found))


def name_overlap(own: Column, other: Column) -> Column:
    """author_overlap of family names that are there already."""
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda x: F.array_contains(other, x))) / F.size(own))


def year_score(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap.isNull(), 0.5).when(gap == 0, 1.0).when(gap == 1, 0.8).otherwise(0.0)


def year_of(c: Column, low: int = 1000, high: int = 2200) -> Column:
    n = c.cast("string").try_cast("double")
    return F.when((n >= low) & (n <= high), F.floor(n).cast("int"))


# --- sections -------------------------------------------------------------------------------------


def entry_score(line: Column) -> Column:
    """How many signs of a bibliography entry a line shows."""
    return sum((F.coalesce(line.rlike(p), F.lit(False)).cast("int") for p in ENTRY_PATTERNS), F.lit(0))


def heading_key(line: Column) -> Column:
    c = F.lower(F.regexp_replace(line, r"^\s*[IVXLCivxlc]+[.)]\s+", ""))
    return F.regexp_replace(without_accents(c), r"[^a-z\x{4e00}-\x{9fff}]+", "")


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 80) & heading_key(line).isin(*SECTION_KEYWORDS)


def before_appendix(c: Column) -> Column:
    """The text before the first line that starts an appendix, unless it starts with one."""
    at = F.regexp_instr(c, F.lit(APPENDIX))
    return F.when(at > 1, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def looks_like_bibliography(c: Column) -> Column:
    return F.exists(F.slice(lines(c), 1, 50), lambda x: entry_score(x) >= 1)


def overflow_citations(body: Column, highest: Column) -> Column:
    """Numbers cited in the text, ranges of under 50 included, above the highest label; in ascending order."""
    groups = F.regexp_extract_all(body, F.lit(CITATION), F.lit(1))
    # Without white space, and with one kind of comma and of dash, each of which splits without an expression.
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.translate(g, ";–— \t\n\x0b\f\r", ",--"), ",")))
    none = F.array().cast("array<int>")

    def spanned(ends: Column) -> Column:
        low, high = F.element_at(ends, 1), F.try_element_at(ends, F.lit(2))
        return F.when(F.size(ends) == 1, ends).when((F.size(ends) == 2) & (high > low) & (high - low < MAX_RANGE), F.sequence(low, high)).otherwise(none)

    numbers = lambda part: let(F.split(part, "-").cast("array<int>"), spanned)
    cited = F.array_distinct(F.flatten(F.transform(parts, numbers)))
    return F.when(highest > 0, F.array_sort(F.filter(F.coalesce(cited, none), lambda n: n > highest))).otherwise(none)


def short_title(title: Column, raw: Column) -> Column:
    t = F.coalesce(title, raw)
    return F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 77), F.lit("..."))).otherwise(t)


def record_link(doi: Column, arxiv_id: Column, url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://doi.org/"), normal_doi(doi)), F.concat(F.lit("https://arxiv.org/abs/"), F.nullif(arxiv_id, F.lit(""))), url)


def is_checkable(kind: Column, title: Column, doi: Column, arxiv_id: Column) -> Column:
    """Whether a record can be looked for at all: no web pages or software, books and theses by DOI only."""
    has_doi = normal_doi(doi).isNotNull()
    named = F.coalesce(title, F.lit("")) != ""
    has_arxiv = F.coalesce(arxiv_id, F.lit("")) != ""
    return F.when(F.coalesce(kind, F.lit("other")).isin("web", "software", "other"), F.lit(False)).when(kind.isin("book", "thesis") & ~has_doi, F.lit(False)).otherwise(named | has_doi | has_arxiv)
