from pyspark.sql import functions as F

from glossator.functions import text as tx
from glossator.operators import review as rv
from glossator.sources import formats
from tests.helpers import SF


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def paragraphs_model(text, least):
    done, open_ = [], ""
    for part in (p.strip() for p in text.split("\n\n")):
        if not part:
            continue
        part = f"{open_}\n\n{part}" if open_ else part
        open_ = "" if len(part) >= least else part
        if not open_:
            done.append(part)
    if open_ and done:
        done[-1] += "\n\n" + open_
    elif open_:
        done.append(open_)
    return done


def test_paragraphs(spark):
    texts = ["a" * 20 + "\n\n" + "b" * 20, "short\n\n" + "c" * 120, "c" * 120 + "\n\nshort", "", " \n\n ", "x\n\ny", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for least in (10, 100):
        got = {r.i: r.p for r in df.select("i", tx.paragraphs(F.col("t"), least).alias("p")).collect()}
        assert [got[i] for i in range(len(texts))] == [paragraphs_model(t or "", least) for t in texts]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    for r in docs.select("text", tx.paragraphs(F.col("text")).alias("p")).collect():
        assert r.p == paragraphs_model(r.text, 100)


def test_passages_pack_without_counting_separators(spark):
    paras = F.array(F.lit("a" * 50), F.lit("b" * 50), F.lit("c"))
    got = one(spark, tx.passages(paras, 100))
    assert [(p.paragraph_indices, len(p.text)) for p in got] == [([0, 1], 102), ([2], 1)]


def test_passages_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", tx.blocks_from_lines(F.col("text")).alias("text"))
    a = rv.with_context(rv.passage_rows(docs, 1500)).collect()
    b = rv.with_context(rv.passage_rows(docs.repartition(7), 1500)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_token_rules(spark):
    assert one(spark, tx.token_count(F.lit("abcdefghi"))) == 2
    assert one(spark, tx.token_chunks(F.lit("a" * 30), 5, 1)) == ["a" * 20, "a" * 14]
    assert one(spark, tx.token_chunks(F.lit(""), 5, 1)) == []


def test_titles_and_slugs(spark):
    assert one(spark, tx.slug(F.lit("My Great Paper: A Study!"))) == "my-great-paper-a-study"
    assert one(spark, tx.slug(F.lit("???"))) is None
    assert one(spark, tx.default_title(F.lit("\n  ## Head \nx"))) == "Head"
    assert one(spark, tx.default_title(F.lit(" \n "))) == "Untitled"
    assert one(spark, tx.markdown_title(F.lit("x\n# **A** b\n# c"))) == "A b"
    assert one(spark, formats.tex_title(F.lit(r"\title{On two \\ lines}"))) == "On two lines"


def test_formats(spark):
    got = [one(spark, formats.detect_format(F.lit(u), F.lit(m))) for u, m in (("https://x.org/a/abc.pdf?X-y=1", None), ("https://x.org/a", "text/plain; charset=utf-8"), ("https://x.org/a", "text/html"), ("no url", None))]
    assert got == ["pdf", "txt", None, None]


def test_front_matter(spark):
    got = one(spark, formats.text_content(F.lit('---\ntitle: "My Paper"\nocr_engine: "x"\n---\nBody')))
    assert (got.title, got.text, got.was_ocr) == ("My Paper", "Body", True)
    got = one(spark, formats.text_content(F.lit("---\nno end")))
    assert (got.title, got.text, got.was_ocr) == ("---", "---\nno end", False)


def test_reflow(spark):
    page = "This is a line of a paragraph that goes on for a whi-\nle and then goes on for another full line of the page\nends here.\nAnother paragraph starts on this line and goes on and on"
    got = one(spark, formats.reflowed(F.lit(page)))
    assert got == "This is a line of a paragraph that goes on for a while and then goes on for another full line of the page ends here.\n\nAnother paragraph starts on this line and goes on and on"


def test_notation(spark):
    docs = spark.createDataFrame([(1, r"\hat{i} and \hat{t} \hat{t} \hat{t}"), (2, r"\hat{x}\hat{x}\hat{y}\hat{y}")], "doc_id long, text string")
    assert [tuple(r) for r in formats.notation_corrections(docs).collect()] == [(1, r"\hat{i}", r"\hat{t}")]
    fixed = {r.doc_id: r.text for r in formats.fix_notation(docs).collect()}
    assert r"\hat{i}" not in fixed[1] and fixed[2].count("y") == 2


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.md").write_text("# Head\n\nBody")
    (tmp_path / "b.tex").write_text(r"\title{T}")
    (tmp_path / "c.bin").write_bytes(b"\0")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    got = {r.path[-5:]: (r.title, r.text, r.error) for r in formats.parse_files(formats.read_files(spark, str(tmp_path))).collect()}
    assert got["/a.md"] == ("Head", "# Head\n\nBody", None)
    assert got["b.tex"] == ("T", r"\title{T}", None)
    assert got[".docx"] == ("One", "One\n\nTwo", None)
    assert got["c.bin"][2].startswith("unsupported")


def test_one_long_text(spark):
    """Work is in proportion to the text: thirty thousand paragraphs in one document."""
    import time

    n = 30_000
    text = "\n\n".join(f"Paragraph {i}." for i in range(n))
    rows = spark.createDataFrame([(text,)], "t string")
    start = time.monotonic()
    got = rows.select(F.size(tx.paragraphs(F.col("t"), 10)).alias("n"), F.size(tx.passages(tx.paragraphs(F.col("t"), 10), 1000)).alias("p"), F.size(tx.packed_lines(F.col("t"), 1000)).alias("l"), F.length(formats.reflowed(F.col("t"))).alias("r")).first()
    assert got.n == n and 450 < got.p < 700 and 450 < got.l < 700 and got.r == len(text)
    assert time.monotonic() - start < 120
