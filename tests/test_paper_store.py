"""The store of papers: what is put in, what stays, reruns, killed runs and two writers."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glossator.plans import report
from glossator.plans.paper_store import PaperStore


def docs_of(spark, *rows):
    return spark.createDataFrame([(d, t, False) for d, t in rows], "doc_id long, text string, was_ocr boolean")


def blocks_of(spark, *rows):
    """doc_id, key and feedback as blocks."""
    df = spark.createDataFrame(list(rows), "doc_id long, key string, f string")
    block = F.struct(F.lit("L").alias("label"), F.lit("m").alias("model"), F.col("f").alias("overall_feedback"), F.array().cast(report.COMMENTS).alias("comments"), F.lit(0.5).alias("cost_usd"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens"))
    return df.select("doc_id", "key", block.alias("block"))


def held(store, number=None):
    return {r.doc_id: (r.title, {k: m.overall_feedback for k, m in r.methods.items()}) for r in store.papers(number).collect()}


def files(path):
    return {str(p): p.read_bytes() for p in Path(path).rglob("*") if p.is_file()}


def test_upsert_replaces_adds_and_keeps(spark, tmp_path):
    store = PaperStore(spark, str(tmp_path / "p"), 4)
    assert store.papers().count() == 0
    assert store.upsert(docs_of(spark, (1, "One"), (2, "Two"), (None, "no one"), (3, None)), blocks_of(spark, (1, "a", "x"), (2, "a", "y"))) == 1
    assert held(store) == {1: ("One", {"a": "x"}), 2: ("Two", {"a": "y"}), 3: ("Untitled", {})}
    assert store.upsert(docs_of(spark, (1, "Renamed"), (4, "Four"), (4, "Four b")), blocks_of(spark, (1, "b", "z"), (1, "a", "w"), (4, "a", "v"))) == 2
    now = {1: ("One", {"a": "w", "b": "z"}), 2: ("Two", {"a": "y"}), 3: ("Untitled", {}), 4: ("Four", {"a": "v"})}
    assert held(store) == now
    assert held(store, 1)[1] == ("One", {"a": "x"})
    assert held(PaperStore(spark, str(tmp_path / "p"), 9)) == now and PaperStore(spark, str(tmp_path / "p"), 9).buckets == 4


def test_a_rerun_writes_no_byte_and_others_keep_their_folders(spark, tmp_path):
    store = PaperStore(spark, str(tmp_path / "p"), 16)
    docs = docs_of(spark, *((i, f"Text {i}") for i in range(60)))
    blocks = blocks_of(spark, *((i, "a", str(i)) for i in range(60)))
    store.upsert(docs, blocks)
    before = files(tmp_path)
    assert store.upsert(docs, blocks) == 1 and store.upsert(docs_of(spark), blocks_of(spark)) == 1
    assert files(tmp_path) == before
    store.upsert(docs_of(spark, (7, "Text 7")), blocks_of(spark, (7, "a", "new")))
    old, new = store.version(1)[1]["folders"], store.version(2)[1]["folders"]
    assert len(old) > 1 and sum(old[b] != new[b] for b in old) == 1
    assert held(store)[7][1] == {"a": "new"} and store.papers().count() == 60


def test_a_killed_run_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = PaperStore(spark, str(tmp_path / "p"), 4)
    store.upsert(docs_of(spark, (1, "One")), blocks_of(spark, (1, "a", "x")))

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(PaperStore, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(docs_of(spark, (1, "One")), blocks_of(spark, (1, "a", "lost")))
    assert held(store) == {1: ("One", {"a": "x"})} and store.versions() == [1]
    store.upsert(docs_of(spark, (1, "One")), blocks_of(spark, (1, "a", "y")))
    store.vacuum(keep=1)
    assert held(store) == {1: ("One", {"a": "y"})} and store.versions() == [2]
    assert len(list((tmp_path / "p" / "data").iterdir())) == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    store = PaperStore(spark, str(tmp_path / "p"), 4)
    store.upsert(docs_of(spark, (1, "One")), blocks_of(spark, (1, "a", "x")))
    said = store.version()[1]
    with pytest.raises(Exception, match="exists"):
        store._publish(1, said)
    assert store.version()[1] == said


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    store = PaperStore(spark, str(tmp_path / "p"), 1)
    docs = docs_of(spark, *((i, f"Text {i}") for i in range(200)))
    assert store.upsert(docs, blocks_of(spark, *((i, "a", str(i)) for i in range(200)))) == 1
    assert len(list((tmp_path / "p" / "data").rglob("*.parquet"))) > 1 and store.papers().count() == 200
