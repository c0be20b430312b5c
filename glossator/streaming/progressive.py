"""The progressive review as a stream: passages come in order, and each document's summary is its state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossator.sources.storage import fresh_path, open_fs, publish, qualified

OUTPUT = "doc_id long, passage_index int, summary string, error string"
RETRIES = 3
#: Milliseconds before the first new attempt; twice that before each further one.
BACKOFF = 1000
#: Characters of a document's new passages that are in hand at a time.
IN_HAND = 4 << 20


class Waiting:
    """Texts of passages that came too early, as files of the shared folder; the state holds their numbers only."""

    def __init__(self, path: str):
        self.fs, self.base = open_fs(path)

    def place(self, doc_id: int, index: int) -> str:
        return f"{self.base}/{doc_id % 256:02x}/{doc_id}-{index}.json"

    def put(self, doc_id: int, index: int, text: str) -> None:
        place = self.place(doc_id, index)
        self.fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(f"{place}.part") as f:
            f.write(json.dumps(text).encode())
        publish(self.fs, f"{place}.part", place)

    def get(self, doc_id: int, index: int) -> str:
        with self.fs.open_input_stream(self.place(doc_id, index)) as f:
            return json.loads(f.read())


def folding(update: Callable[[str, str, int], str], most_chars: int, path: str, timers: bool = False, retries: int = RETRIES, backoff: int = BACKOFF, ttl: int | None = None) -> type:
    """A processor that folds passages into a summary by ``update(summary, passage, index)``.

    Passages that were folded already are passed over, so a batch that is sent again changes nothing. Those that can be
    folded at once never enter the state, which each question to it costs a message. Those that come
    too early wait: their texts in files under ``path``, under names that a batch which runs again writes anew, and
    their numbers in the state. Files stay until the folder is cleared, for a batch that fails later reads them again.

    An ``update`` that raises ends the stream, unless there are ``timers``. Then its document waits ``backoff`` milliseconds, then twice that, and
    so on, and is tried again by a timer, while others go on. After ``retries`` attempts the passage is passed over: its
    row has the error, and the summary before it stays.
    """

    class Folding(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.summary = handle.getValueState("summary", "next int, text string, attempts int", ttl)
            self.waiting = handle.getMapState("waiting", "passage_index int", "size int", ttl)
            self.texts = Waiting(path)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            doc_id, state = key[0], self.held()
            waits = self.waiting.exists()
            fresh: dict[int, str] = {}
            size = 0
            for r in rows:
                i, t = int(r["passage_index"]), r["text"] or ""
                if i < state[0] or i in fresh or (waits and self.waiting.containsKey((i,))):
                    continue
                fresh[i] = t
                size += len(t)
                if size > IN_HAND:
                    state = yield from self.folded(doc_id, state, fresh, waits, timerValues)
                    waits, size = self.put_away(doc_id, fresh) or waits, 0
            state = yield from self.folded(doc_id, state, fresh, waits, timerValues)
            self.put_away(doc_id, fresh)
            self.summary.update(state)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            state = yield from self.folded(key[0], self.held(), {}, True, timerValues, again=True)
            self.summary.update(state)

        def held(self) -> tuple[int, str, int]:
            at, text, attempts = self.summary.get() or (0, "", 0)
            return int(at), text or "", int(attempts)

        def put_away(self, doc_id: int, fresh: dict[int, str]) -> bool:
            """Passages that are left wait; whether there are any."""
            for i, t in fresh.items():
                self.texts.put(doc_id, i, t)
                self.waiting.updateValue((i,), (len(t),))
            some = bool(fresh)
            fresh.clear()
            return some

        def folded(self, doc_id: int, state: tuple[int, str, int], fresh: dict[int, str], waits: bool, timer_values, again: bool = False) -> Iterator[Row]:
            """Rows of the passages that can be folded now; returns the state after them. They leave ``fresh`` or the state."""
            at, text, attempts = state
            # A document whose last attempt failed waits for its timer.
            while again or not attempts:
                there = at in fresh
                if not there and not (waits and self.waiting.containsKey((at,))):
                    break
                passage = fresh[at] if there else self.texts.get(doc_id, at)
                try:
                    text, error = update(text, passage, at)[:most_chars], None
                except Exception as e:  # noqa: BLE001  told in the row
                    if not timers:
                        raise
                    attempts += 1
                    if attempts < retries:
                        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + backoff * 2 ** (attempts - 1))
                        break
                    error = f"{type(e).__name__}: {e}"
                if there:
                    del fresh[at]
                else:
                    self.waiting.removeKey((at,))
                yield Row(doc_id=doc_id, passage_index=at, summary=text, error=error)
                at, attempts = at + 1, 0
            return at, text, attempts

        def close(self) -> None:
            pass

    return Folding


def running_summaries(passages: DataFrame, update: Callable[[str, str, int], str], most_tokens: int = 4000, path: str | None = None, timers: bool = False, retries: int = RETRIES, backoff: int = BACKOFF, ttl: int | None = None) -> DataFrame:
    """doc_id, passage_index, the summary after it, and error, for a stream of passages (doc_id, passage_index, text).

    State is one summary for each document and the numbers of passages that came too early, whose texts are under
    ``path``: give the same one to each start of a stream, as with its checkpoint. The state lives in the state store,
    so a restart goes on where it was. With ``timers`` calls that fail are tried again, rows with an error are passages
    that ``retries`` attempts could not fold, and with ``ttl`` (milliseconds) a document's state goes when nothing came
    for so long. Such a stream is for continuous triggers: with one that ends when all input is read it would not end.
    """
    spark = passages.sparkSession
    processor = folding(update, most_tokens * 4, qualified(spark, path or fresh_path(spark, "waiting")), timers, retries, backoff, ttl if timers else None)
    return passages.groupBy("doc_id").transformWithState(statefulProcessor=processor(), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime" if timers else "None")
