"""Titles of fetched pages whose references are cut."""

from __future__ import annotations

from glossator.sources import formats


def test_incomplete_references_of_a_title_stay(spark):
    titles = {"a": "the&amp;&amp;&amp", "b": "x &lt; y &#39;z&#39; &amp;lt;", "c": "A & B &amp", "d": "&amp;"}
    rows = [(f"http://x/{k}", "text/html", f"<html><head><title> {t} </title></head><body>&amp</body></html>".encode(), None) for k, t in titles.items()]
    got = {r.url[-1]: (r.title, r.text) for r in formats.parse_fetched(spark.createDataFrame(rows, "url string, media_type string, content binary, error string")).collect()}
    assert got == {"a": ("the&&&amp", "&"), "b": ("x < y 'z' &lt;", "&"), "c": ("A & B &amp", "&"), "d": ("&", "&")}
