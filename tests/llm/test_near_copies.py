"""The pipeline's near-duplicate stage against all pairs by brute force."""

import random

import corpus_pipeline
from glossator.llm import near_copies as nc
from tests.helpers import SF

DOC = "doc_id long, text string"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def kept_model(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.random()}"
    return " ".join(w)


def sample(spark, n):
    return [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def test_stage_drops_all_near_copies(spark):
    r = random.Random(4)
    texts = sample(spark, 60)
    texts += [edited(r, t, k) for t in texts[:30] for k in (1, 2, 4, 8)]
    prose = " ".join(f"w{r.randrange(900)}" for _ in range(300))
    texts += [prose, *(edited(r, prose, k % 12) for k in range(40))]
    line = " ".join(f"c{i}" for i in range(12))
    texts += [f"{line}\n" + " ".join(f"u{r.randrange(900)}" for _ in range(r.randint(0, 30))) for _ in range(60)]
    texts += [None, "", " \n", "One", "one", "a b c d", "a b c d e", "A b\tc d e"]
    expected = kept_model(texts)
    for frequent in (3, 10**9):
        held, nc.FREQUENT = nc.FREQUENT, frequent
        try:
            got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(list(enumerate(texts)), DOC), SF)
            assert {x.doc_id for x in got.collect()} == expected
        finally:
            nc.FREQUENT = held


def test_edges(spark):
    rows = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 3), (5, "A B", 4)], DOC + ", token int")
    got = nc.drop_near_copies(rows)
    assert got.columns == ["doc_id", "text", "token"]
    assert sorted((x.doc_id is None, x.text) for x in got.collect()) == [(False, "a b")]
    assert nc.drop_near_copies(rows.limit(0)).count() == 0


def test_shingles_are_counted_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(nc, "SENT", 9)
    line = "a line that stands in many texts of all there are"
    texts = [f"{line} and {i} follows" for i in range(50)] + [f"three more words before {i // 3} come" for i in range(30)] + [None, ""]
    docs = spark.createDataFrame([(i, f"{t} {i}" if t else t) for i, t in enumerate(texts)], DOC)
    docs = docs.union(spark.range(40_000).selectExpr("id + 1000", "'x y'"))
    counts = {}
    for t in {f"{t} {i}" if t else "" for i, t in enumerate(texts)} | {"x y"}:
        for s in shingles(t):
            h = int(nc.shingle_set(s)[0])
            counts[h] = counts.get(h, 0) + 1
    texts = nc.keyed(docs, "doc_id", "text").repartition(7, "node")  # a text's copies in one task
    got = nc.shingle_counts(texts).collect()
    assert sorted((x.token % (1 << 64), x["count"]) for x in got) == sorted((h, n) for h, n in counts.items() if n >= 3)
    token, count = nc.frequent_shingles(texts)
    assert list(count) == [50] * 8 and set(token.tolist()) == {h for h, n in counts.items() if n == 50}
    assert len(nc.frequent_shingles(texts.limit(0))[0]) == 0
