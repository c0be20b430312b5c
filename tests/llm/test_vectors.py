"""Vector codes and hard negatives, against SQL (in test_rest) and plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator.llm import hard_negatives as hn
from glossator.llm import vector_codes as vc
from glossator.llm.vectors import largest

VEC = "vec_id long, embedding array<float>, label int"


def plain_integers(rows, scale, most):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = max((len(r[1]) for r in kept), default=0)
    f32 = lambda x: float(np.float32(x))
    return [(i, [max(-most, min(most, math.floor(f32(x) * scale))) for x in v] + [0] * (dims - len(v)), lab) for i, v, lab in kept]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    found = plain_integers(rows, 1024, largest(max(4, -(-max([len(r[1] or []) for r in rows], default=0) // 4) * 4), 2))
    if not found:
        return []
    width = max(1, -(-len(found[0][1]) // parts))
    found = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in found]
    ordered = sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in ordered] for p in range(parts)]

    def near(x, book):
        d, e = min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
        return e, d

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in found:
                members[near(cut(v, p), books[p])[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(members, books[p], strict=True)]
    coded = []
    for i, v, lab in found:
        pairs = [near(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for e, _ in pairs), sum(d for _, d in pairs), lab))
    sums = {}
    for _, _, e, lab in coded:
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab], digest) for i, c, e, lab in coded), key=repr)


ODD = [
    (1000, None, 3), (1001, [1.0, None, 0.5], 3), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, 1),
    (None, [0.25] * 8, None), (1004, [0.5, -0.5], None), (1005, [], 2), (7, [0.1] * 8, 2), (7, [0.1] * 8, 2), (1006, [3e38] * 8, 4), (1007, [-3e38] * 8, 4),
]


def vectors(n, dims=8, seed=1, grid=None):
    r = random.Random(seed)
    one = lambda: [round(r.gauss(0, 0.3) * grid) / grid if grid else r.gauss(0, 0.3) for _ in range(dims)]
    return [(i, one(), r.choice([0, 1, 2, 3, None]) if i % 9 == 0 else r.randrange(4)) for i in range(n)]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [vectors(700), vectors(600, grid=4) + ODD, vectors(20, 7) + ODD, [(1, None, 1)], []])
def test_codes_equal_plain_python(spark, rows):
    df = spark.createDataFrame(rows, VEC).repartition(3).selectExpr("*", "1 AS code", "2 AS v", "3 AS error")
    assert sorted_rows(vc.vector_code_report(df)) == plain_codes(rows)


def test_screening_keeps_the_best_where_float32_cannot_tell(spark):
    """Distances that differ in the last bits of numbers far beyond what float32 holds."""
    r = np.random.default_rng(3)
    base = r.integers(-(1 << 26), 1 << 26, (1, 16))
    book = base + r.integers(-2, 3, (64, 16))
    x = base + r.integers(-2, 3, (500, 16))
    exact = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    index, far = vc.nearest(x, book)
    assert (index == exact.argmin(1)).all() and (far == exact.min(1)).all()
    product = book.astype(np.float32) @ x.astype(np.float32).T
    naive = ((book * book).sum(1)[:, None] - 2 * product.astype(np.float64)).argmin(0)
    assert (naive != exact.argmin(1)).any()


def test_screening_leaves_little_to_compute():
    r = np.random.default_rng(4)
    x, book = r.integers(-500, 500, (2000, 16)), r.integers(-500, 500, (256, 16))
    rows, _ = vc.screened(x, book)
    assert len(x) <= len(rows) < 1.1 * len(x)


def test_equal_entries_go_to_the_lower_index():
    book = np.array([[5, 5], [1, 1], [1, 1], [-1, -1]])
    assert vc.nearest(np.array([[1, 1], [0, 0], [5, 5]]), book)[0].tolist() == [1, 1, 0]


def test_many_labels_are_joined_by_salt(spark, monkeypatch):
    rows = vectors(300, grid=4) + ODD
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 1)
    assert sorted_rows(vc.vector_code_report(spark.createDataFrame(rows, VEC))) == plain_codes(rows)


def test_decoded_vectors_are_near(spark):
    rows = vectors(300, grid=8)
    codes, books = vc.vector_codes(spark.createDataFrame(rows, VEC))
    by = {r.vec_id: r for r in vc.decoded(codes, books).collect()}
    for i, v, _ in rows:
        off = sum((math.floor(np.float32(a) * 1024) - b * 1024) ** 2 for a, b in zip(v, by[i].vector, strict=True))
        assert round(off) == by[i].error


# --- hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows, every, least_share=80):
    dims = max([len(r[1]) for r in rows if r[1] is not None], default=1) or 1
    found = [r for r in plain_integers(rows, 256, largest(dims, 7)) if r[0] is not None and r[2] is not None]
    by = {}
    for i, v, lab in sorted(found, key=lambda r: (r[2], r[1])):
        by.setdefault(i, (i, v, lab))
    found, out = list(by.values()), []
    for a, x, lab in found:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, y, other in found if i != a)
        for ps, p, _ in [s for s in scored if s[2] == lab][:5]:
            near = [s for s in scored if s[2] != lab and least_share * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [vectors(900, 70), vectors(500, grid=4) + ODD, vectors(30, 3, grid=2) + [(4, [1.0, 1.0, 1.0], 0)], [(1, None, 1)], [], [(0, [1.0], 1)]])
@pytest.mark.parametrize("shards", [(4096, 256), (64, 3)])
def test_negatives_equal_plain_python(spark, monkeypatch, rows, shards):
    monkeypatch.setattr(hn, "ROWS", shards[0])
    monkeypatch.setattr(hn, "ANCHORS", shards[1])
    df = spark.createDataFrame(rows, VEC).repartition(3).selectExpr("*", "1 AS id", "2 AS v", "3 AS anchor")
    assert sorted_rows(hn.hard_negatives(df, df.vec_id % 10 == 0)) == plain_negatives(rows, 10)


def test_windows_that_are_shuffled_give_the_same(spark, monkeypatch):
    rows = vectors(400, 40, grid=4)
    monkeypatch.setattr(hn, "ROWS", 64)
    monkeypatch.setattr(hn, "ANCHORS", 8)
    monkeypatch.setattr(hn, "BROADCAST_WINDOWS", 0)
    df = spark.createDataFrame(rows, VEC)
    assert sorted_rows(hn.hard_negatives(df, df.vec_id % 10 == 0)) == plain_negatives(rows, 10)


def test_products_beyond_float64_are_exact():
    a = np.array([[(1 << 24) - 1, -(1 << 24) + 3]] * 40).reshape(1, -1)
    assert hn.product(a, a)[0, 0] == sum(int(x) ** 2 for x in a[0])


def test_scores_come_from_the_tiles(spark, monkeypatch):
    """Without one chunk's tiles the scores are others."""
    rows = vectors(200, 64, grid=4)
    df = spark.createDataFrame(rows, VEC)
    whole = sorted_rows(hn.hard_negatives(df, df.vec_id % 10 == 0))
    partial = hn.partial_tiles
    monkeypatch.setattr(hn, "partial_tiles", lambda *a: partial(*a).where("k = 0"))
    assert sorted_rows(hn.hard_negatives(df, df.vec_id % 10 == 0)) != whole


def test_no_tile_leaves_its_cell(spark):
    """What is shuffled grows as the rows, not as anchors times rows."""
    n, dims = 1200, 64
    df = spark.createDataFrame(vectors(n, dims, grid=4), VEC).selectExpr("vec_id AS id", "CAST(label AS long) AS label", "CAST(embedding AS array<double>) AS v")
    own = hn.pieces(df, dims, 2, 256)
    rows = hn.partial_tiles(own, own.withColumn("windows", F.lit(None).cast("array<struct<id:long,score:long>>")), 1, 1)
    held = rows.agg(*(F.sum(F.length(c)).alias(c) for c, t in rows.dtypes if t == "binary")).first()
    assert sum(held) == 2 * n * dims * 4
