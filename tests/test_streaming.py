"""Running summaries: passages that come too early wait, repeated ones change nothing, a restart goes on, and a document
whose calls fail holds up no other."""

import os
import time

import pytest

from glossator.streaming.progressive import Waiting, running_summaries

SCHEMA = "doc_id long, passage_index int, text string"


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(out)

    def send(rows, update, until=None, **options):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(SCHEMA).parquet(source)
        made = running_summaries(read, update, path=str(tmp_path / "waiting"), timers=until is not None, **options)
        write = made.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", state)
        found = lambda: {(r.doc_id, r.passage_index): (r.summary, r.error) for r in spark.read.schema("doc_id long, passage_index int, summary string, error string").parquet(out).collect()}
        if until is None:
            write.trigger(availableNow=True).start().awaitTermination()
        else:
            q, end = write.trigger(processingTime="300 milliseconds").start(), time.time() + 60
            try:
                while q.isActive and time.time() < end and not until(found()):
                    time.sleep(0.5)
                assert q.exception() is None
            finally:
                q.stop()
        return found()

    return send


def joined(s, p, i):
    return f"{s}|{i}{p}"


def test_running_summaries(stream):
    one = lambda rows: {k: s for k, (s, _) in stream(rows, joined, most_tokens=3).items()}
    assert one([(1, 1, "b"), (2, 0, "x")]) == {(2, 0): "|0x"}
    assert one([(1, 0, "a"), (2, 0, "y")]) == {(2, 0): "|0x", (1, 0): "|0a", (1, 1): "|0a|1b"}
    assert one([(1, 2, "c" * 99)])[1, 2] == "|0a|1b|2cccc"


def test_state_holds_no_text_of_early_passages(stream, spark, tmp_path):
    """Ten thousand early passages of 1,000 characters: their texts lie in files, and the state's entries are numbers."""
    text = "t" * 1000
    stream([(1, i, text) for i in range(1, 10_001)], joined)
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state"))
    entries = state.selectExpr("user_map_key.passage_index AS k", "user_map_value.size AS n").collect() if "user_map_key" in state.columns else state.selectExpr("explode(map_value) AS (k, v)").selectExpr("k.passage_index AS k", "v.size AS n").collect()
    assert sorted(e.k for e in entries) == list(range(1, 10_001)) and {e.n for e in entries} == {1000}
    held = sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(tmp_path / "state") for f in files if "/state" in d)
    assert held < 2_000_000  # of 10 MB of text
    got = stream([(1, 0, "first")], lambda s, p, i: f"{i}:{len(p)}")
    assert len(got) == 10_001 and got[1, 10_000] == ("10000:1000", None)


def test_failures_wait_for_their_timer_and_others_go_on(stream, tmp_path):
    """Document 1 fails twice, document 2 always at its second passage; document 3 is not kept waiting."""

    def update(s, p, i):
        if p == "twice":
            with open(tmp_path / "attempts", "a") as f:
                f.write("x")
            if os.path.getsize(tmp_path / "attempts") < 3:
                raise OSError("down")
        if p == "always":
            raise ValueError("no such thing")
        return joined(s, p, i)

    rows = [(1, 0, "twice"), (1, 1, "b"), (2, 0, "a"), (2, 1, "always"), (2, 2, "c"), (3, 0, "z")]
    first = stream(rows, update, until=lambda got: (3, 0) in got, backoff=2000)
    assert first[3, 0] == ("|0z", None) and (1, 0) not in first
    got = stream([(3, 1, "y")], update, until=lambda got: len(got) == 7, backoff=200)
    assert got == {
        (1, 0): ("|0twice", None), (1, 1): ("|0twice|1b", None), (2, 0): ("|0a", None),
        (2, 1): ("|0a", "ValueError: no such thing"), (2, 2): ("|0a|2c", None), (3, 0): ("|0z", None), (3, 1): ("|0z|1y", None),
    }
    assert os.path.getsize(tmp_path / "attempts") == 3


def test_waiting_texts(tmp_path):
    w = Waiting(str(tmp_path))
    w.put(-5, 2, "é\n")
    w.put(-5, 2, "other")
    assert w.get(-5, 2) == "other"


class State:
    """A state variable that counts the questions to it."""

    def __init__(self):
        self.asked, self.value, self.map = 0, None, {}

    def __getattr__(self, name):
        def ask(*a):
            self.asked += 1
            if name == "update":
                self.value = a[0]
            elif name == "updateValue":
                self.map[a[0]] = a[1]
            elif name == "removeKey":
                self.map.pop(a[0], None)
            return {"get": self.value, "exists": bool(self.map), "containsKey": bool(a) and a[0] in self.map}.get(name)

        return ask


def test_passages_in_order_ask_the_state_three_times(tmp_path):
    from pyspark.sql import Row

    from glossator.streaming.progressive import folding

    class Handle:
        getValueState = getMapState = lambda self, *a: State()

    p = folding(joined, 100, str(tmp_path))()
    p.init(Handle())
    got = list(p.handleInputRows((1,), iter([Row(passage_index=i, text=str(i)) for i in (0, 2, 1, 0)]), None))
    assert [(r.passage_index, r.summary) for r in got] == [(0, "|00"), (1, "|00|11"), (2, "|00|11|22")]
    assert p.summary.asked + p.waiting.asked == 3 and p.summary.value == (3, "|00|11|22", 0)
