"""That the near-duplicate stage finds copies through SimHash and Golay keys, and the rest without them."""

import random

import corpus_pipeline
from glossator.llm import near_copies as nc
from glossator.llm import simhash as sh
from tests.helpers import SF
from tests.llm.test_near_copies import edited, kept_model

DOC = "doc_id long, text string"


def texts_of(r):
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(400)) for _ in range(12)]
    return base + [edited(r, t, 1) for t in base]


def nothing(cols):
    return []


def also_nothing(cols):
    return []


def still_nothing(cols):
    return []


def test_sketches_alone_find_close_copies(spark, monkeypatch):
    texts = texts_of(random.Random(7))
    for name, f in zip(("with_first", "neighbours", "cross_pairs"), (nothing, also_nothing, still_nothing), strict=True):
        monkeypatch.setattr(nc, name, f)
    got = {x.doc_id for x in corpus_pipeline.deduplicate(spark, spark.createDataFrame(list(enumerate(texts)), DOC), SF).collect()}
    assert kept_model(texts) <= got  # nothing is dropped that is no near copy
    assert len(got) < len(texts) - 6  # most copies of one changed word are within reach of the keys


def test_join_finds_what_sketches_miss(spark, monkeypatch):
    texts = texts_of(random.Random(8))
    monkeypatch.setattr(nc, "sketched_pairs", lambda nodes: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).limit(0))
    got = {x.doc_id for x in corpus_pipeline.deduplicate(spark, spark.createDataFrame(list(enumerate(texts)), DOC), SF).collect()}
    assert got == kept_model(texts)


def test_equal_fingerprints_and_keys_meet(spark):
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(40)]
    near = [f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in fps]
    signed = [f - (1 << 64) if f >> 63 else f for f in [*fps, *near, *fps]]
    met = {(x.a, x.b) for x in nc.sketched_pairs(spark.createDataFrame(list(enumerate(signed)), "node long, fp long")).collect()}
    assert met == {(i, i + 40) for i in range(40)} | {(i, i + 80) for i in range(40)}
    assert sh.majority(sh.set_bits(sh.np.array(fps[:1], "<u8")), 1) == fps[0]
