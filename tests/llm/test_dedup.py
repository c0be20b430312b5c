"""Line dedup, SimHash and long repeats against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from glossator.llm import simhash as sh
from glossator.llm.components import connected_components
from glossator.llm.line_dedup import deduplicate_lines, line_report
from glossator.llm.repeats import remove_repeats, repeats_digest
from tests.helpers import SF

DOC = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


# --- lines ----------------------------------------------------------------------------------------


def lines_model(docs, reach=3):
    seen, gone = {}, {}
    order = sorted((i for i, t in enumerate(docs) if t is not None), key=lambda i: i)
    for i in order:
        ls = docs[i].split("\n")
        for k in range(len(ls) - reach + 1):
            if seen.setdefault(tuple(ls[k : k + reach]), (i, k)) != (i, k):
                gone.setdefault(i, set()).update(range(k, k + reach))
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    r = random.Random(seed)
    words = "abcdefgh"[: 3 + seed]
    texts = ["\n".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(60)] + [None, "", "a\n" * 30]
    got = {x.doc_id: x.text for x in deduplicate_lines(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == lines_model(texts)


def test_line_dedup_edges(spark):
    rows = spark.createDataFrame([(None, "a\nb\nc", 1), (1, "a\nb\nc", 2), (1, "a\nb\nc", 2), (2, None, 3)], "doc_id long, text string, n_lines int")
    out = deduplicate_lines(rows)
    assert out.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_removed"]
    got = sorted(((x.doc_id, x.text, x.n_removed) for x in out.collect()), key=str)
    assert got == sorted([(None, "", 3), (1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, None, 0)], key=str)
    assert line_report(docs_of(spark, [])).count() == 0


# --- SimHash --------------------------------------------------------------------------------------


def fingerprint_model(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components_model(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash(spark):
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    r = random.Random(1)
    near = []
    for t in base[:40]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "x"
        near.append(" ".join(w))
    texts = base + near + [None, "", " \n ", "One", "one TWO", "ÉÀ İ ß\u00a0x y z"]
    ids = [*range(len(texts) - 1), None]
    fps = [fingerprint_model(t) for t in texts]
    expected = components_model(fps, ids)
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), DOC)
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in sh.simhash_components(rows).collect()}
    assert [got[d] for d in ids] == list(zip(fps, expected, strict=True))
    kept = {x.doc_id for x in sh.drop_near_duplicates(rows).collect()}
    assert kept == {c for c in expected if c is not None} | ({None} if expected[-1] is None else set())
    assert sh.simhash_components(docs_of(spark, [])).count() == 0


def test_links_of_dense_groups():
    import numpy as np

    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (6, 150, 3)).astype(np.uint64)
    fp = np.unique((centre[:, None] ^ flips[:, :, 0] ^ np.where(rng.random((6, 150)) < 0.5, flips[:, :, 1], 0).astype(np.uint64)).ravel())
    expected = components_model([int(x) for x in fp], list(range(len(fp))))
    a, b = sh.span(fp)
    assert roots_of(fp, a.tolist(), b.tolist()) == expected


def roots_of(fp, a, b):
    place = {int(x): i for i, x in enumerate(fp)}
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a, b, strict=True):
        i, j = find(place[x]), find(place[y])
        root[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("largest", [100_000, 8, 1])
def test_large_buckets_leave_their_task(spark, monkeypatch, largest):
    """Keys with more fingerprints than a task may hold give the same components, by rows."""
    import numpy as np

    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 120, 3)).astype(np.uint64)
    fp = np.unique((centre[:, None] ^ flips[:, :, 0] ^ np.where(rng.random((4, 120)) < 0.5, flips[:, :, 1], 0).astype(np.uint64)).ravel())
    expected = components_model([int(x) for x in fp], list(range(len(fp))))
    monkeypatch.setattr(sh, "LARGEST_BUCKET", largest)
    monkeypatch.setattr(sh, "along_salts", counting(sh.along_salts, calls := []))
    rows = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "16")  # so that keys go on from batch to batch
    try:
        links, star = (sh.fingerprint_links(rows, f).collect() for f in (sh.span, sh.star))
    finally:
        spark.conf.unset(conf)
    unsigned = lambda x: x % (1 << 64)
    assert roots_of(fp, [unsigned(x.a) for x in links], [unsigned(x.b) for x in links]) == expected
    assert bool(calls) == (largest < 9)
    low = roots_of(fp, [unsigned(x.a) for x in star], [unsigned(x.b) for x in star])
    assert all(low[i] == low[root] for i, root in enumerate(expected))


def counting(f, calls):
    return lambda *a: calls.append(1) or f(*a)


def test_keys_are_made_by_all_tasks(spark):
    """The repartition before the expansion is in the plan that runs, though an aggregate dealt by the same column."""
    fps = spark.range(5000).select(((F.col("id") % 700) * 7919).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tasks(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        k = sum(b.num_rows for b in batches)
        if k:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([k])], names=["key", "fp"])

    made = sh.fuzzy_key_rows(fps, tasks)
    rows = made.collect()
    assert len(rows) == n and sum(r.fp for r in rows) == 700
    assert made._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- long repeats ---------------------------------------------------------------------------------


def repeats_model(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(0, 20_000), (1, 20_000), (2, 2)])
def test_repeats(spark, seed, hot):
    r = random.Random(seed)
    alphabet = "ab" if seed == 1 else "abcdéfgh "
    rnd = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [rnd(r.randint(20, 80)) for _ in range(6)]
    texts = [None, "", "aaa" * 40]
    for _ in range(40):
        t = "".join(r.choice([rnd(r.randint(5, 40)), r.choice(shared)[r.randint(0, 15) :]]) for _ in range(r.randint(1, 6)))
        texts += [t, t[: len(t) // 2] + "Z" + t[len(t) // 2 :]][: 1 + (r.random() < 0.3)]
    texts += texts[5:8]
    got = {x.doc_id: tuple(x)[1:] for x in repeats_digest(docs_of(spark, texts), length=24, gram=10, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_model(texts, 24)


def test_repeats_on_sample_at_production_length(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {x.doc_id: tuple(x)[1:] for x in repeats_digest(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_model(texts, 200)


def test_repeats_edges(spark):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(500))
    rows = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, "short", "y")], "doc_id long, text string, kept string")
    got = sorted((x.doc_id or 0, x.n_removed, bytes(x.kept)) for x in remove_repeats(rows).collect())
    assert got == [(0, 0, b"short"), (1, 500, b""), (1, 500, b"")]
    assert remove_repeats(docs_of(spark, [])).count() == 0


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    from glossator.llm import repeats

    r = random.Random(9)
    part = "".join(r.choice("abcdefgh ") for _ in range(700))
    texts = ["".join(r.choice("abcdefgh ") for _ in range(3000)) + part + "x", "y" + part + "".join(r.choice("abcdefgh ") for _ in range(2000))]
    monkeypatch.setattr(repeats, "BLOCK", 256)
    got = {x.doc_id: tuple(x)[1:] for x in repeats_digest(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(2)] == repeats_model(texts, 200)


def test_repeats_of_rows_that_share_their_id_or_have_none(spark):
    r = random.Random(6)
    rnd = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = rnd(60)
    texts = [rnd(r.randint(0, 80)) + shared[: r.choice([0, 10, 40, 60])] + rnd(r.randint(0, 50)) for _ in range(40)]
    ids = [None if i % 3 == 0 else 7 for i in range(40)]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), DOC)
    got = sorted((tuple(x) for x in repeats_digest(rows, length=24, gram=10).collect()), key=repr)
    assert got == sorted(((i, *m) for i, m in zip(ids, repeats_model(texts, 24), strict=True)), key=repr)
