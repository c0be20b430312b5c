import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from glossator.functions import citations as ct
from glossator.functions.similarity import locate, ratio
from glossator.operators import references as rf
from tests.test_text import one

REF = "doc_id long, ref_index int, label string, raw string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, kind string"
CAND = "doc_id long, ref_index int, source string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string, matched_by string, cand_ord int"


@pytest.mark.parametrize(("doi", "expected"), [("https://doi.org/10.1234/ABC", "10.1234/abc"), ("doi: 10.1234/abc", "10.1234/abc"), ("not-a-doi", None), (None, None), ("10.1016/0007- 6813(84)90046-6", "10.1016/0007-6813(84)90046-6")])
def test_doi(spark, doi, expected):
    assert one(spark, ct.normal_doi(F.lit(doi).cast("string"))) == expected


def test_identifiers_and_names(spark):
    assert one(spark, ct.arxiv_id_of_doi(F.lit("10.48550/arXiv.2212.08073"))) == "2212.08073"
    assert one(spark, ct.arxiv_id_of_doi(F.lit("10.1038/nature14539"))) is None
    assert one(spark, ct.normal_arxiv_id(F.lit("arXiv: 2212.08073v3"))) == "2212.08073"
    assert one(spark, ct.normal_title(F.lit(r"\emph{Über} Widget--Learning: A {Study}"))) == one(spark, ct.normal_title(F.lit("Uber Widget Learning A Study")))
    assert [one(spark, ct.family_name(F.lit(a))) for a in ("A. Smith", "Smith, Alice", "van der Berg, J.", "et al.", "J. K.")] == ["smith", "smith", "berg", "", ""]


def test_scores(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, ct.author_overlap(arr("A. Smith", "B. Jones"), arr("Alice Smith", "Robert Jones"))) == 1.0
    assert one(spark, ct.author_overlap(arr("A. Smith"), arr("Carol Chen"))) == 0.0
    years = [(2020, 2020), (2020, 2021), (2020, 2023), (None, 2020)]
    assert [one(spark, ct.year_score(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in years] == [1.0, 0.8, 0.0, 0.5]


def test_overflow(spark):
    body = F.lit("See [1] and [2,3] or [5-7], also [12]; not [1-80] or [x].")
    assert one(spark, ct.overflow_citations(body, F.lit(4))) == [5, 6, 7, 12]
    assert one(spark, ct.overflow_citations(body, F.lit(0))) == []


@pytest.mark.parametrize("heading", ["## References", "References", "R E F E R E N C E S", "6 References", "IV. REFERENCES:", "REFERENCES CITED:", "Références", "参考文献"])
def test_headings(spark, heading):
    docs = spark.createDataFrame([(1, f"Intro\n\n{heading}\n[1] Smith, A. A thing. 2020.\n\n## Appendix\nmore")], "doc_id long, text string")
    got = rf.find_sections(docs).first()
    assert got and got.source == "heading" and got.section == "[1] Smith, A. A thing. 2020."


def test_sections_by_shape_and_none(spark):
    entries = "\n".join(f"[{i}] Smith, A. Thing {i}. J. Things 3({i}), 20{i:02d}." for i in range(6))
    docs = spark.createDataFrame([(1, "prose line\n" * 40 + entries), (2, "References\nonly prose follows"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.source for r in rf.find_sections(docs).collect()}
    assert got == {1: "structural"}


def test_quoted_line(spark):
    docs = spark.createDataFrame([(1, "a\n[1] Smith, A. 2020\nb"), (2, "a"), (3, "x [1] Doe 2001 y")], "doc_id long, text string")
    answers = spark.createDataFrame([(1, " [1] Smith, A. 2020 \nrest"), (2, "NONE"), (3, "[1] Nobody")], "doc_id long, response string")
    assert [(r.doc_id, r.offset) for r in rf.at_quoted_line(docs, answers).collect()] == [(1, 2)]


def ref(**x):
    return Row(**({"doc_id": 1, "ref_index": 0, "label": None, "raw": "raw", "title": "Deep widgets for all", "authors": ["A. Smith"], "year": 2020, "venue": None, "doi": None, "arxiv_id": None, "kind": "paper"} | x))


def cand(**x):
    return Row(**({"doc_id": 1, "ref_index": 0, "source": "crossref", "title": "Deep Widgets for All", "authors": ["Alice Smith"], "year": 2020, "venue": None, "doi": None, "arxiv_id": None, "url": None, "matched_by": "search", "cand_ord": 0} | x))


CASES = [
    ({}, [], "not_found"),
    ({}, [{}], "verified"),
    ({}, [{"year": 2016}], "mismatch"),
    ({}, [{"authors": ["Carol Chen"]}], "mismatch"),
    ({"doi": "10.1/x"}, [{"title": "Nothing alike, zzz", "doi": "10.1/x", "matched_by": "doi"}], "mismatch"),
    ({"doi": "10.1/x"}, [{"doi": "10.1/x", "matched_by": "doi"}], "verified"),
    ({}, [{"title": "Deep gadgets for most", "authors": ["Bo Li"]}], "ambiguous"),
    ({}, [{"title": "Quarks", "authors": ["Bo Li"], "year": 1990}], "not_found"),
    ({"arxiv_id": "1"}, [{"title": "junk zzz", "matched_by": "doi"}, {"matched_by": "arxiv", "cand_ord": 1}], "verified"),
    ({"title": None, "arxiv_id": "1"}, [{"matched_by": "arxiv"}], "verified"),
]


@pytest.mark.parametrize(("r", "cs", "status"), CASES)
def test_classify(spark, r, cs, status):
    refs = spark.createDataFrame([ref(**r)], REF)
    cands = spark.createDataFrame([cand(**c) for c in cs], CAND)
    assert rf.classify(refs, cands).first().status == status


def test_equal_doi_scores_one(spark):
    refs, cands = spark.createDataFrame([ref(doi="10.1/A")], REF), spark.createDataFrame([cand(title="other", doi="10.1/a")], CAND)
    assert rf.scored(refs, cands).first().score == 1.0


def test_outage_is_not_a_miss(spark):
    refs = spark.createDataFrame([ref(), ref(ref_index=1), ref(ref_index=2, kind="web")], REF)
    catalog = spark.createDataFrame([], "record_id long, source string, source_rank int, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string")
    outcomes = spark.createDataFrame([(1, 0, 3, 3), (1, 1, 3, 1)], "doc_id long, ref_index int, attempted long, errored long")
    got = {r.ref_index: r.status for r in rf.check(refs, catalog, outcomes).collect()}
    assert got == {0: "unverifiable", 1: "not_found", 2: "unverifiable"}


def test_verdicts(spark):
    checked = spark.createDataFrame([(1, 0, "ambiguous"), (1, 1, "ambiguous"), (1, 2, "verified")], "doc_id long, ref_index int, status string")
    verdicts = spark.createDataFrame([(1, 0, "Mismatch", "year"), (1, 1, "perhaps", "")], "doc_id long, ref_index int, verdict string, explanation string")
    got = {r.ref_index: (r.status, r.adjudicated) for r in rf.adjudicated(checked, verdicts).collect()}
    assert got == {0: ("mismatch", True), 1: ("ambiguous", True), 2: ("verified", False)}


def test_locate():
    assert locate("brown fox", ["none", "the brown fox runs"]) == 1
    assert locate("zzzz qqqq", ["the brown fox runs"]) is None
    table = "| a | b | " * 100 + "the 7 percent gain of model x over model y in table two " + "| c | d | " * 100
    assert locate("the 7 percent gainn of modell x over model y in table two", ["short", table]) == 1
    assert ratio("", "") == 1.0


def test_titles_decompose_as_unicode_does(spark):
    """Every code point, between two letters: the normal title is that of its compatibility decomposition."""
    import re
    import unicodedata

    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.range(0, len(points), 1, 8).select(F.col("id")).join(spark.createDataFrame([(k, f"a{chr(i)}b") for k, i in enumerate(points)], "id long, t string"), "id")
    got = {r.id: r.n for r in rows.select("id", ct.normal_title(F.col("t")).alias("n")).collect()}

    def plain(t):
        t = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", t))
        t = re.sub(r"[{}$]", "", re.sub(r"\\[a-zA-Z]+", " ", t))
        return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", t)).strip()

    lowered = {r.id: r.l for r in rows.select("id", F.lower("t").alias("l")).collect()}
    wrong = [hex(points[k]) for k in got if got[k] != plain(lowered[k])]
    assert not wrong, wrong[:20]


def test_overflow_reads_a_range_once(spark):
    """Values with all kinds of dashes and white space, and no part of a citation is split again for each use of it."""
    body = F.lit("See [ 1 ] is none, [9 ,\t30 – 32;7], [40—41; 50-99], [60-\n10] and [8-8].".replace("[ 1 ]", "[1]"))
    assert one(spark, ct.overflow_citations(body, F.lit(6))) == [7, 9, 30, 31, 32, 40, 41, *range(50, 100)]
    made = spark.range(1).select(ct.overflow_citations(F.lit("[1]"), F.col("id")).alias("n"))
    assert made._jdf.queryExecution().analyzed().toString().count("split(") == 2
