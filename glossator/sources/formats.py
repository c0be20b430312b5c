"""Raw bytes, texts and pages as documents: doc_id or path, title, text, was_ocr."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossator.functions import text as tx
from glossator.functions.text import trim

# Formats by file extension and by media type.
BY_EXTENSION = {".pdf": "pdf", ".docx": "docx", ".tex": "tex", ".txt": "txt", ".md": "md", ".markdown": "md"}
BY_MEDIA_TYPE = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/x-tex": "tex",
    "text/x-tex": "tex",
    "text/markdown": "md",
    "text/plain": "txt",
}
PARSED = "title string, text string, was_ocr boolean, error string"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def is_url(c: Column) -> Column:
    return F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))


def format_of_path(path: Column) -> Column:
    """Format by the extension; null for none or another one."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    return F.try_element_at(literal_map(BY_EXTENSION), extension)


def detect_format(url: Column, media_type: Column | None = None) -> Column:
    """Format by the URL's path, query left out, else by the media type; null for HTML and what is unknown."""
    by_path = format_of_path(F.try_parse_url(url, F.lit("PATH")))
    if media_type is None:
        return by_path
    mime = F.lower(trim(F.substring_index(media_type, ";", 1)))
    return F.coalesce(by_path, F.try_element_at(literal_map(BY_MEDIA_TYPE), mime))


# --- texts ----------------------------------------------------------------------------------------


def tex_title(raw: Column) -> Column:
    r"""The argument of \title without commands and braces; else the first line."""
    t = F.regexp_replace(trim(F.regexp_extract(raw, r"\\title\{([^}]+)\}", 1)), r"\\\\", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+\{([^}]*)\}", "$1"), "[{}]", "")
    return F.coalesce(F.nullif(tx.squeeze(t), F.lit("")), F.substring(tx.first_line(raw), 1, tx.TITLE_CHARS), F.lit(""))


def text_content(raw: Column) -> Column:
    """struct(title, text, was_ocr) of plain text or markdown, front matter taken off and read."""
    end = F.locate("\n---\n", raw, 5)
    has = F.startswith(raw, F.lit("---\n")) & (end > 0)
    front = F.when(has, F.substring(raw, F.lit(5), end - 5))
    body = F.when(has, F.substring(raw, end + 5, F.length(raw))).otherwise(raw)
    told = F.filter(F.split(front, "\n"), lambda x: F.startswith(x, F.lit("title:")))
    named = F.regexp_replace(trim(F.substring(F.try_element_at(told, F.lit(-1)), 7, 1 << 30)), '^"|"$', "")
    first = tx.first_line(body)
    by_line = F.when(F.startswith(first, F.lit("#")), trim(F.regexp_replace(first, r"^#+\s*", ""))).otherwise(F.substring(first, 1, tx.TITLE_CHARS))
    ocr = F.exists(F.split(front, "\n"), lambda x: F.startswith(x, F.lit("ocr_engine:")))
    return F.struct(F.coalesce(F.nullif(named, F.lit("")), by_line, F.lit("")).alias("title"), body.alias("text"), F.coalesce(ocr, F.lit(False)).alias("was_ocr"))


#: What parts paragraphs while a page is put together; it is no character of a text.
PARTED = "\x01"


def reflowed(page: Column) -> Column:
    """Paragraphs of a page whose lines were broken by its layout, parted by blank lines.

    Words hyphenated at a line's end are joined. A paragraph ends at a blank line, at a line under seven
    tenths of the median width that ends a sentence or stands before a new start, and at one under nine tenths
    that does both.
    """
    own = F.transform(tx.lines(page), trim)
    wide = lambda own: F.array_sort(F.filter(F.transform(own, F.length), lambda n: n > 30))

    def flowed(own: Column, median: Column) -> Column:
        following = F.concat(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), F.array(F.lit("")))

        def marked(line: Column, after: Column) -> Column:
            ends = line.rlike(r"""[.?!:]["')\]]?$""")
            starts = (after == "") | after.rlike(r"""^[A-Z0-9"'(\[]""")
            width = F.length(line)
            last = (line == "") | ((width < 0.7 * median) & (ends | starts)) | ((width < 0.9 * median) & ends & starts)
            return F.concat(line, F.when(last, PARTED).otherwise("\n"))

        # Whether a paragraph ends is told by its lines alone, so all are joined at once and parted again.
        whole = F.array_join(F.zip_with(own, following, marked), "")
        plain = lambda p: F.replace(F.regexp_replace(p, "-\n(?=[a-z])", ""), F.lit("\n"), F.lit(" "))
        return F.array_join(F.filter(F.transform(F.split(whole, PARTED), lambda p: trim(plain(p))), lambda p: p != ""), "\n\n")

    def with_median(own: Column) -> Column:
        middle = lambda w: F.coalesce(F.try_element_at(w, (F.floor(F.size(w) / 2) + 1).cast("int")), F.lit(80))
        return tx.let(tx.let(wide(own), middle), lambda m: flowed(own, m))

    return tx.let(own, with_median)


def joined_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """doc_id, title, text, pages of raw page texts (doc_id, page_index, text); only the first ``max_pages`` count.
    Documents without any text are left out."""
    rows = pages if max_pages is None else pages.where(F.col("page_index") < max_pages)
    flowed = rows.select("doc_id", "page_index", reflowed(F.coalesce("text", F.lit(""))).alias("t"))
    ordered = F.array_sort(F.collect_list(F.when(trim(F.col("t")) != "", F.struct("page_index", "t"))))
    docs = flowed.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_join(F.transform(ordered, lambda p: p.t), "\n\n").alias("text"))
    return docs.where("text <> ''").select("doc_id", tx.markdown_title(F.col("text")).alias("title"), "text", "pages")


# --- doubtful notation ----------------------------------------------------------------------------

# Letters that recognition takes for one another: a choice of ours, for no list of them is published.
CONFUSABLE = ("il", "it", "lt", "uv", "nm", "ce", "oa", "gq")
LEAST_FREQUENT = 3


def notation_corrections(docs: DataFrame) -> DataFrame:
    """doc_id, old, new: a one-letter argument of a LaTeX accent that occurs once in a document, where a letter it is
    often taken for has the same accent three times or more; the more frequent one is meant."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\\(?:hat|bar|tilde|vec|dot)\{[A-Za-z]\}"), F.lit(0))).alias("m"))
    n = found.groupBy("doc_id", "m").count().select("doc_id", "m", "count", F.regexp_extract("m", r"^(.*)\{", 1).alias("accent"), F.regexp_extract("m", r"\{(.)\}", 1).alias("x"))
    pairs = F.array(*(F.lit(p) for p in (*CONFUSABLE, *(p[::-1] for p in CONFUSABLE))))
    once = n.where("count = 1").select("doc_id", "accent", F.col("m").alias("old"), F.col("x").alias("a"))
    often = n.where(F.col("count") >= LEAST_FREQUENT).select("doc_id", "accent", F.col("m").alias("new"), F.col("x").alias("b"), "count")
    met = once.join(often, ["doc_id", "accent"]).where(F.array_contains(pairs, F.concat("a", "b")))
    return met.groupBy("doc_id", "old").agg(F.max(F.struct("count", "new")).alias("w")).select("doc_id", "old", "w.new")


def fix_notation(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the corrections made and listed in ``corrections``."""
    fixes = notation_corrections(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("corrections"))
    rows = docs.join(fixes, "doc_id", "left")
    fixed = F.aggregate(F.coalesce("corrections", F.array().cast("array<struct<old:string,new:string>>")), F.col("text"), lambda t, c: F.replace(t, c.old, c.new))
    return rows.withColumn("text", fixed)


# --- files ----------------------------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, format and content of every file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", format_of_path(F.col("path")).alias("format"), "content")


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, one a line."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{ns}p"):
        out.append("".join("\t" if e.tag == f"{ns}tab" else "\n" if e.tag == f"{ns}br" else e.text or "" for e in p.iter() if e.tag in (f"{ns}t", f"{ns}tab", f"{ns}br")))
    return "\n".join(out)


def decode(files: DataFrame, pdf_pages=None, max_pages: int | None = None) -> DataFrame:
    """files (path, format, content) with ``raw`` text and ``error``. Text formats are decoded in the JVM, DOCX by a
    function; PDF needs ``pdf_pages``, a function from bytes to page texts, and is an error without it. Pages are
    taken from it one by one, ``max_pages`` at most, so a reader that yields them reads no others. A bad file is
    an error in its own row, not of the job."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, errors = [], []
            for kind, content in zip(b["format"], b["content"], strict=True):
                try:
                    if kind == "docx":
                        raw.append(docx_text(bytes(content)))
                    elif kind == "pdf" and pdf_pages:
                        raw.append("\f".join(islice(pdf_pages(bytes(content)), max_pages)))
                    else:
                        raise ValueError(f"unsupported format: {kind}")
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any parser's failure belongs to its row
                    raw.append(None)
                    errors.append(str(e))
            yield b[["path", "format"]].assign(raw=raw, error=errors)

    plain = files.where("format in ('txt', 'md', 'tex')").select("path", "format", F.decode("content", "UTF-8").alias("raw"), F.lit(None).cast("string").alias("error"))
    other = files.where("format is null or format not in ('txt', 'md', 'tex')").mapInPandas(run, "path string, format string, raw string, error string")
    return plain.unionByName(other)


def parse_files(files: DataFrame, pdf_pages=None, max_pages: int | None = None) -> DataFrame:
    """path, format, title, text, was_ocr, error of every file."""
    rows = decode(files, pdf_pages, max_pages)
    content = text_content(F.col("raw"))
    blocks = tx.blocks_from_lines(F.col("raw"))
    pdf = F.array_join(F.filter(F.transform(F.split("raw", "\f"), reflowed), lambda p: trim(p) != ""), "\n\n")
    text = F.when(F.col("format") == "docx", blocks).when(F.col("format") == "tex", F.col("raw")).when(F.col("format") == "pdf", pdf).otherwise(content["text"])
    title = F.when(F.col("format") == "docx", F.substring(tx.first_line(F.col("raw")), 1, tx.TITLE_CHARS)).when(F.col("format") == "tex", tex_title(F.col("raw"))).when(F.col("format") == "pdf", tx.markdown_title(pdf)).otherwise(content["title"])
    ocr = F.when(F.col("format") == "pdf", True).when(F.col("format").isin("docx", "tex"), False).otherwise(content["was_ocr"])
    return rows.select("path", "format", title.alias("title"), text.alias("text"), ocr.alias("was_ocr"), "error")


def fetch(urls: DataFrame, get, url: str = "url") -> DataFrame:
    """url, media_type, content, error of every URL by ``get(url) -> (status, media type, bytes)``. Pages of the
    preprint server are asked for as HTML first and as PDF if that fails."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                tries = [u]
                if "arxiv.org/abs/" in u:
                    tries = [u.replace("arxiv.org/abs/", "arxiv.org/html/"), u.replace("arxiv.org/abs/", "arxiv.org/pdf/")]
                error = None
                for t in tries:
                    try:
                        status, media, content = get(t)
                        if 200 <= status < 300:
                            rows.append((u, media, content, None))
                            break
                        error = f"HTTP {status}"
                    except Exception as e:  # noqa: BLE001  an outage belongs to its row
                        error = str(e)
                else:
                    rows.append((u, None, None, error))
            yield pd.DataFrame(rows, columns=["url", "media_type", "content", "error"])

    return urls.select(F.col(url).alias("url")).mapInPandas(run, "url string, media_type string, content binary, error string")


def parse_fetched(fetched: DataFrame, pdf_pages=None, max_pages: int | None = None) -> DataFrame:
    """url, format, title, text, was_ocr, error of what ``fetch`` brought: by the URL's extension or the media type,
    else as a web page if it is one or does not say."""
    from glossator.sources.html import parse_pages

    mime = F.lower(trim(F.substring_index("media_type", ";", 1)))
    rows = fetched.withColumn("format", detect_format(F.col("url"), F.col("media_type"))).withColumn("_mime", mime)
    failed = rows.where("content is null").select("url", "format", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("was_ocr"), F.coalesce("error", F.lit("no content")).alias("error"))
    got = rows.where("content is not null")
    files = parse_files(got.where("format is not null").select(F.col("url").alias("path"), "format", "content"), pdf_pages, max_pages).withColumnRenamed("path", "url")
    is_page = F.col("_mime").isNull() | F.col("_mime").isin("", "text/html", "application/xhtml+xml")
    pages = parse_pages(got.where(F.col("format").isNull() & is_page).select("url", "format", F.decode("content", "UTF-8").alias("html")), keep_loose=True)
    pages = pages.select("url", "format", "title", "text", F.lit(False).alias("was_ocr"), "error")
    other = got.where(F.col("format").isNull() & ~is_page).select("url", "format", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("was_ocr"), F.concat(F.lit("unsupported media type: "), F.col("media_type")).alias("error"))
    return files.select("url", "format", "title", "text", "was_ocr", "error").unionByName(pages).unionByName(other).unionByName(failed)


def parse_documents(spark: SparkSession, places: list[str], get=None, pdf_pages=None, max_pages: int | None = None) -> DataFrame:
    """place, format, title, text, was_ocr, error of everything at the places: files and folders by their path, URLs
    by ``get`` (see ``fetch``)."""
    fields = ["format", "title", "text", "was_ocr", "error"]
    urls = [p for p in places if p.startswith(("http://", "https://"))]
    out = None
    for p in places:
        if p not in urls:
            rows = parse_files(read_files(spark, p), pdf_pages, max_pages).select(F.col("path").alias("place"), *fields)
            out = rows if out is None else out.unionByName(rows)
    if urls:
        if get is None:
            raise ValueError("URLs need a function that gets them")
        fetched = fetch(spark.createDataFrame([(u,) for u in urls], "url string"), get)
        rows = parse_fetched(fetched, pdf_pages, max_pages).select(F.col("url").alias("place"), *fields)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"place string, format string, {PARSED}")
    return out
