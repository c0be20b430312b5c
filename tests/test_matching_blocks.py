"""Matching blocks over arrays, and quotes that no score can anchor."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from glossator.functions import similarity as si
from glossator.operators import review as rv


def test_coverage_equals_difflib():
    r = random.Random(3)
    for letters in ("ab", "abcdefgh é𝒳"):
        for _ in range(300):
            a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, n))) for n in (60, 200))
            blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
            assert si.coverage(a, b) == (sum(x.size for x in blocks) / len(a) if a else 0.0)


def test_no_matcher_where_no_score_can_reach(spark, monkeypatch):
    paras = spark.createDataFrame([(1, 0, 0, "some words of it"), (1, 0, 1, "others")], "doc_id long, bin int, paragraph_index int, para string")
    asks = spark.createDataFrame([(1, 0, "words of"), (1, 0, "words xf")], "doc_id long, passage_index int, quote string")
    monkeypatch.setattr(rv, "covering_paragraph", lambda *a: pytest.fail("matched"))
    got = {r.quote: r.paragraph_index for r in rv.anchored(asks, paras, 3, threshold=1.01).collect()}
    assert got == {"words of": 0, "words xf": None}
