"""That results come through the methods: positions that winnowing selects, sketches, postings, and work in
proportion to one long text."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator.llm import decontamination as dc
from glossator.llm import line_dedup as ld
from glossator.llm import secrets, toxicity
from glossator.llm.common import small, weights
from tests.llm.test_dedup import docs_of, lines_model

DOC = "doc_id long, text string"


# --- winnowing ------------------------------------------------------------------------------------


def selected_of(spark, texts, gram, window):
    keyed = docs_of(spark, texts).select("doc_id", F.lit(0).alias("tie"), ld.lines_of(F.col("text")).alias("lines")).where("text is not null")
    return ld.selected(keyed, gram, window)


@pytest.mark.parametrize(("gram", "window"), [(1, 1), (1, 3), (2, 2), (3, 4), (4, 5)])
def test_winnowing_selects_window_minima(spark, gram, window):
    r = random.Random(gram)
    texts = ["\n".join(f"line {r.randrange(30)}" for _ in range(r.randint(1, 40))) for _ in range(40)]
    rows = selected_of(spark, texts, gram, window).collect()
    reach = gram + window - 1
    # Each run of the guarantee is told by exactly one position, which lies within it.
    told = Counter((x.doc_id, x["at"] - e) for x in rows for e in x.lefts)
    assert told == Counter((i, s) for i, t in enumerate(texts) for s in range(t.count("\n") + 2 - reach))
    assert all(0 <= e < window for x in rows for e in x.lefts)
    # The position holds the window's least hash, the last of equal ones.
    fps = {(x.doc_id, x["at"]): x.fp for x in rows}
    every = {(x.doc_id, x["at"]): x.fp for x in selected_of(spark, texts, gram, 1).collect()}
    for x in rows:
        for e in x.lefts:
            s = x["at"] - e
            assert x["at"] == max(range(s, s + window), key=lambda k: (-every[x.doc_id, k], k))
    assert fps.items() <= every.items()


def test_winnowing_keeps_few_positions(spark):
    text = "\n".join(f"unlike {i}" for i in range(4000))
    for window in (2, 4, 9):
        n = selected_of(spark, [text], 2, window).count()
        assert n == pytest.approx(4000 * 2 / (window + 1), rel=0.1)


def test_runs_meet_by_their_fingerprints(spark, monkeypatch):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\nd\ny"]
    assert [x.n_removed for x in ld.line_report(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 4]
    real = ld.selected
    monkeypatch.setattr(ld, "selected", lambda *a: real(*a).withColumn("fp", F.monotonically_increasing_id()))
    assert [x.n_removed for x in ld.line_report(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 0]


def test_matches_are_extended_both_ways(spark, monkeypatch):
    """Positions hold no run, only their lines on either side: without the walk over these nothing is a repeat."""
    texts = ["a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "c\nd\ne\nz"]
    assert [x.n_removed for x in ld.line_report(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 4, 3]
    assert set(selected_of(spark, texts, 1, 3).columns) == {"doc_id", "tie", "at", "fp", "lefts", "before", "after"}
    real = ld.extension
    for side in ("before", "after"):
        monkeypatch.setattr(ld, "extension", lambda own, other, most, side=side: F.lit(0) if own == side else real(own, other, most))
        assert [x.n_removed for x in ld.line_report(docs_of(spark, texts)).orderBy("doc_id").collect()] != [0, 4, 3]


def test_runs_that_part_from_the_first_are_matched_further(spark):
    """A line that all have, in surroundings of which some repeat: the first position with the fingerprint has none of them."""
    r = random.Random(4)
    texts = ["\n".join(x for _ in range(6) for x in (f"l{r.randrange(4)}", "hot", f"r{r.randrange(4)}")) for _ in range(60)]
    texts.insert(0, "alone\nhot\nalone too")
    got = {x.doc_id: x.text for x in ld.deduplicate_lines(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == lines_model(texts)


@pytest.mark.parametrize(("gram", "window"), [(1, 1), (2, 2), (1, 3), (3, 3), (2, 5), (1, 7)])
def test_line_dedup_of_any_guarantee(spark, gram, window):
    r = random.Random(window)
    texts = ["\n".join(r.choice("abcd") for _ in range(r.randint(0, 30))) for _ in range(50)] + [None, "", "a\n" * 30]
    got = {x.doc_id: x.text for x in ld.deduplicate_lines(docs_of(spark, texts), gram=gram, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == lines_model(texts, gram + window - 1)


def test_lines_of_one_long_text(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(100_000))
    start = time.monotonic()
    rows = ld.line_report(docs_of(spark, [text, text])).orderBy("doc_id").collect()
    assert [(x.n_lines, x.n_removed) for x in rows] == [(100_000, 0), (100_000, 100_000)]
    assert rows[0].kept_sha256 == hashlib.sha256(text.encode()).hexdigest() and time.monotonic() - start < 60


# --- sketches -------------------------------------------------------------------------------------


def bench(spark):
    r = random.Random(8)
    items = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in (4, 9, 20, 60, 60)]
    docs = []
    for i in range(120):
        w = list(items[i % 5])
        for k in r.sample(range(len(w)), min(len(w), i % 7)):
            w[k] = "other"
        docs.append((i, " ".join([f"x{r.randrange(10**6)}" for _ in range(r.randint(0, 400))] + w)))
    return spark.createDataFrame(docs, DOC), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")


def test_sketches_are_minima_of_size_partitions(spark):
    _, items = bench(spark)
    rows = dc.item_table(items, "item_id", "text", 5, 0.8).collect()
    lengths: dict[int, set[int]] = {}
    for item in {x["item"] for x in rows}:
        own = sorted((x for x in rows if x["item"] == item), key=lambda x: x.hash)
        kept = [x for x in own if x.sketch]
        lengths.setdefault(own[0].n, set()).add(len(kept))
        assert kept == own[: len(kept)] and len(own) == own[0].n and own[0].need == math.ceil(0.8 * len(own) - 1e-9)
        assert len(kept) == own[0].n - own[0].need + 1
    assert all(len(v) == 1 for v in lengths.values())
    assert sum(x.sketch for x in rows) < 0.4 * len(rows)


def test_candidates_come_from_sketches_and_none_is_missed(spark, monkeypatch):
    docs, items = bench(spark)
    table = dc.item_table(items, "item_id", "text", 5, 0.8)
    met = {tuple(x) for x in dc.sketch_candidates(docs, table).collect()}
    true = {(x.doc_id, x.item_id) for x in dc.contained_items(docs, items).collect()}
    assert true and true <= met and len(met) > len(true)
    monkeypatch.setattr(dc, "sketch_candidates", lambda *a, **k: spark.createDataFrame([], "doc_id long, item long"))
    assert dc.contained_items(docs, items).count() == 0


def test_verification_counts_words_not_hashes(spark, monkeypatch):
    docs, items = bench(spark)
    true = {tuple(x) for x in dc.contained_items(docs, items).collect()}
    real = F.xxhash64
    monkeypatch.setattr(dc.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(50)))
    assert {tuple(x) for x in dc.contained_items(docs, items).collect()} == true


def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(14))  # ten shingles, eight needed
    exact, below = " ".join(f"w{i}" for i in range(12)), " ".join(f"w{i}" for i in range(11))
    rows = [(1, exact, 5, 0), (1, exact, 5, 0), (2, below, 1, 1), (3, "w0 w1 w2 w3 w4 w5", 0, 0), (3, exact[18:], 0, 0), (None, item, 0, 0), (4, None, 0, 0), (5, "x " * 300_000 + item, 0, 0)]
    docs = spark.createDataFrame(rows, DOC + ", item long, hash long")
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (None, item, 2)], "item_id long, text string, doc_id long")
    got = sorted(((x.doc_id, x.item_id, x.n_found, x.containment) for x in dc.contained_items(docs, items).collect()), key=str)
    # Rows of a doc_id are one document; its two rows give document 3 four shingles only.
    assert got == sorted([(d, i, n, n / 10) for d, n in ((1, 8), (None, 10), (5, 10)) for i in (7, None)], key=str)
    left = dc.decontaminate(docs, items)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {2, 3, 4}


# --- postings -------------------------------------------------------------------------------------

TEXTS = ["password = hunter22", "AKIA" + "B" * 16, "a" * 30, "nothing here", None, "the token is gone", "TOKEN: abcdefgh", "akia and kia", "-----BEGIN RSA PRIVATE KEY-----"]


def test_postings_are_inverted_and_intersected(spark):
    docs = docs_of(spark, TEXTS)
    postings = secrets.trigram_postings(docs)
    got: dict[str, set[int]] = {}
    for x in postings.collect():
        got.setdefault(x.trigram, set()).add(x.doc_id)
    rules = secrets.BASE + secrets.MORE
    for t in secrets.wanted(rules):
        assert got.get(t, set()) == {i for i, s in enumerate(TEXTS) if s and t in s.lower()}, t
    found = {x.doc_id: {r.kind for i, r in enumerate(rules) if x.rules >> i & 1} for x in secrets.candidates(postings).collect()}
    assert found == {0: {"assign"}, 1: {"access"}, 5: {"assign"}, 6: {"assign"}, 7: {"access"}, 8: {"private_key"}}


def test_only_candidates_are_searched(spark):
    docs = docs_of(spark, TEXTS)
    whole = {x.doc_id: x.spans for x in secrets.secret_report(docs).collect()}
    assert whole[0].startswith("assign:0:") and whole[1].startswith("access:") and whole[2].startswith("hex:")
    none = secrets.trigram_postings(docs).limit(0)
    bare = {x.doc_id: (x["assign"], x["access"], x["hex"]) for x in secrets.secret_spans(docs, postings=none).collect()}
    assert bare[0][0] == [] and bare[1][1] == [] and len(bare[2][2]) == 1  # hex has no trigram and is searched everywhere


def test_secrets_edges(spark):
    rows = [(1, "token=abcdefg", 1, "x"), (1, "token=abcdefg", 2, "x"), (None, "token=abcdefg", 3, None), (2, None, 4, "y")]
    docs = spark.createDataFrame(rows, DOC + ", tie int, rules string")
    got = sorted(((x.doc_id, x.n_assign, x.spans) for x in secrets.secret_report(docs).collect()), key=str)
    assert got == sorted([(1, 1, "assign:0:13")] * 2 + [(None, 1, "assign:0:13"), (2, 0, "")], key=str)


def test_many_secrets_in_one_text(spark):
    start = time.monotonic()
    text = " ".join(f"{i:024x}" for i in range(200_000))
    row = secrets.secret_report(docs_of(spark, [text])).first()
    assert row.n_hex == 200_000 and row.spans.startswith("hex:0:24,hex:25:49,") and row.spans.endswith(f"hex:{25 * 199_999}:{25 * 200_000 - 1}")
    assert time.monotonic() - start < 60


# --- toxicity -------------------------------------------------------------------------------------


def test_segments_are_linear():
    n = 300_000
    start = time.monotonic()
    found = toxicity.segments(np.arange(n) * 10, np.ones(n), 0.5)
    assert len(found) == n and time.monotonic() - start < 10


def test_odds_decay_and_score(spark):
    """The model against its definition, worked out over all units of a small sample."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(r.choices(["vile", "hateful", "hated", "scum"] if toxic and r.random() < 0.9 else ["plain"], k=3) + r.choices(["the", "house", "harbour", "river", "stone"], k=30))))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    import zlib

    train = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    words = [Counter(w for t, y in train if y == side for w in set(t.split())) for side in (0, 1)]
    count = [Counter(), Counter()]
    for side in (0, 1):
        for w, n in words[side].items():
            for u in toxicity.units(w):
                count[side][u] += n
    total = [sum(c.values()) for c in count]
    every = set(count[0]) | set(count[1])
    prior = {u: toxicity.LEAST_PRIOR + (count[0][u] + count[1][u]) * toxicity.PRIOR / sum(total) for u in every}
    weight = sum(prior.values())
    odds = {u: math.log((count[1][u] + prior[u]) / (total[1] + weight)) - math.log((count[0][u] + prior[u]) / (total[0] + weight)) for u in every}
    z = {u: odds[u] / math.sqrt(1 / (count[1][u] + prior[u]) + 1 / (count[0][u] + prior[u])) for u in every}
    telling = {u: odds[u] for u in every if count[1][u] >= toxicity.LEAST_DOCS and odds[u] >= toxicity.LEAST_ODDS + toxicity.DRIFT and z[u] >= toxicity.LEAST_Z}
    assert telling and model.odds == pytest.approx(telling)

    def word_score(w):
        return max((telling[u] for u in toxicity.units(w) if u in telling), default=0.0) - toxicity.DRIFT

    # The decay is where the expectation of exp(decay * score) over clean tokens is 1.
    tokens = Counter(round(word_score(w), 1) for t, y in train if not y for w in t.split())
    tokens[round(max(telling.values()) - toxicity.DRIFT, 1)] += 1
    assert sum(n * math.exp(model.decay * s) for s, n in tokens.items()) / tokens.total() == pytest.approx(1, abs=1e-6)

    def evidence(text):
        x = [word_score(w) for w in text.split()]
        at = [i for i, s in enumerate(x) if s > 0]
        found = toxicity.segments(np.array(at), np.array([x[i] for i in at]), toxicity.DRIFT)
        means = sorted(toxicity.SCALE * len(x) * math.exp(-model.decay * s) for *_, s in found)
        tails = [-math.log10(max(1e-300, 1 - sum(math.exp(-m) * m**k / math.factorial(k) for k in range(n)))) for n, m in enumerate(means, 1) if m > 1e-4]
        return means, math.log1p(max(tails, default=0.0))

    for _, t in rows[:60]:
        means, expected = evidence(t)
        if all(m > 1e-4 for m in means):  # below, the plain sum loses its figures
            assert model.evidence(t) == pytest.approx(expected, rel=1e-3, abs=1e-6)
    scores = {x.doc_id: x.score for x in toxicity.toxicity_report(docs, marks).collect()}
    assert all(scores[i] == pytest.approx(1 / (1 + math.exp(-(model.intercept + model.slope * model.evidence(t))))) for i, t in rows)


# --- slices ---------------------------------------------------------------------------------------


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    r = random.Random(1)
    texts = [None if i % 9 == 0 else "x" * r.choice([0, 10, 5000]) for i in range(500)]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[1] * (i % 3) for i in range(500)])], names=["t", "l"])
    parts = list(small([b], rows=100, size=20_000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or (weights(p).sum() <= 20_000 and p.num_rows <= 100) for p in parts)
    assert [p.num_rows for p in small([b.slice(0, 0)])] == [0]
