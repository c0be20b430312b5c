"""Language identification with language-bitmask n-gram filters.

All languages' Bloom filters lie side by side: row r of a bit-sliced filter holds bit r of every language.
A character n-gram is hashed to a few rows, and the AND of these is the set of all languages that contain
it. A text's n-grams are looked up at once; each language counts its hits, the count is corrected for the
false positives that the filling of its filter lets expect, and the highest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import durable, id_crc, lots, worker_cache

#: Texts that each language's n-grams are learned from, at most; a hash of id and language chooses them.
SAMPLE = 4_000
#: Languages whose counts may be broadcast.
BROADCAST_LANGUAGES = 100_000
#: Texts that are counted together, for each has a count for each language.
TOGETHER = 512
GRAM = 4
#: A language contains an n-gram if it is one in so many of its n-grams or more, and not much more rarely than elsewhere. Of
#: a language with fewer n-grams than that, one occurrence is enough.
ONE_IN, LEAST_SHARE = 1_000_000, 0.15
#: Rows of the filter for each n-gram of the fullest language, and how many of them an n-gram has.
ROWS_PER_GRAM, PROBES = 12, 3
UNKNOWN = "und"
#: Code points to a block, about.
BLOCK = 1 << 20


def letter_table() -> np.ndarray:
    """By code point: whether it is a letter."""
    cache = worker_cache("language")
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram, and the number of letters in each text. Texts are lowered; runs of
    anything but letters are one space, before and after the text too; n-grams of spaces alone don't occur."""
    data = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    # Lowering may change lengths, so bounds are found again by the line ends that the texts had none of.
    ends = np.flatnonzero(data == 10)
    letter = letter_table()[np.minimum(data, 0x10FFFF)]
    points = np.where(letter, data, 32).astype(np.uint64)
    number = np.zeros(len(data), np.int64)
    number[ends] = 1
    number = np.cumsum(number)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    letters = np.bincount(number[letter], minlength=len(texts))
    points, number, letter = points[keep], number[keep], letter[keep]
    # A space before each text's first word is the one after the last word of the text before.
    points = np.concatenate([[np.uint64(32)], points])
    number = np.concatenate([number[:1], number])
    n = len(points) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), letters
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    owner = number[1 : n + 1]
    within = number[1 : n + 1] == number[GRAM - 1 :]
    return h[within], owner[within], letters


def clean(texts: Iterable[str | None]) -> list[str]:
    return [(t or "").replace("\n", " ") for t in texts]


def blocks(texts: list[str], most: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in runs of about ``most`` code points (BLOCK), longer ones cut between words: each piece's text
    number, and the pieces."""
    owners, held, size, most = [], [], 0, most or BLOCK
    for k, t in enumerate(texts):
        for piece in lots(t, most):
            owners.append(k)
            held.append(piece)
            size += len(piece)
            if size >= most:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


@dataclass
class LanguageFilter:
    """languages in order of their bits, the filter's rows (64 languages a column), and each one's false-positive rate."""

    languages: list[str]
    table: np.ndarray
    rates: np.ndarray
    fallback: str = UNKNOWN

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], fallback: str) -> LanguageFilter:
        fullest = max((len(m) for m in members), default=0)
        rows = 1 << max(10, (max(1, fullest) * ROWS_PER_GRAM - 1).bit_length())
        width = 64 if len(languages) > 32 else 32 if len(languages) > 16 else 16 if len(languages) > 8 else 8
        table = np.zeros((rows, -(-max(1, len(languages)) // width)), f"<u{width // 8}")
        rates = np.zeros(len(languages))
        for i, m in enumerate(members):
            bit = table.dtype.type(1 << (i % width))
            for at in cls.rows(m, rows):
                table[at, i // width] |= bit
            rates[i] = float((table[:, i // width] & bit != 0).mean()) ** PROBES
        return cls(languages, table, rates, fallback)

    @staticmethod
    def rows(h: np.ndarray, rows: int) -> Iterator[np.ndarray]:
        for i in range(PROBES):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield (h >> np.uint64(16)) & np.uint64(rows - 1)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Of each n-gram the languages that contain it, as bits."""
        first, *more = (self.table[at] for at in self.rows(h, len(self.table)))
        for m in more:
            first = first & m
        return first

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: the share that the best corrected count has among all."""
        texts = clean(texts)  # a line end within a text would count as the start of another
        width = self.table.dtype.itemsize * 8
        letters, n = np.zeros(len(texts)), np.zeros(len(texts))
        hits = np.zeros((len(texts), max(1, len(self.languages))))
        for owners, part in blocks(texts, max(1, BLOCK // self.table.shape[1])):
            h, owner, own_letters = grams(part)
            np.add.at(letters, owners, own_letters)
            np.add.at(n, owners, np.bincount(owner, minlength=len(part)))
            masks = self.masks(h)
            for i in range(len(self.languages)):
                found = (masks[:, i // width] >> masks.dtype.type(i % width)) & masks.dtype.type(1)
                np.add.at(hits[:, i], owners, np.bincount(owner, found, minlength=len(part)))
        for i, rate in enumerate(self.rates):
            hits[:, i] = np.maximum(0.0, (hits[:, i] - n * rate) / max(1e-9, 1 - rate))
        best, top, total = hits.argmax(axis=1), hits.max(axis=1), hits.sum(axis=1)
        return [(UNKNOWN, 0.0) if not letters[k] else (self.fallback, 0.0) if not top[k] else (self.languages[best[k]], float(top[k] / total[k])) for k in range(len(texts))]


def fit_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageFilter:
    """Learns every language of the rows whose crc32(id) mod 3 is not 1, from ``sample`` texts a language at most.

    What comes to the driver is a count for each language and the n-grams that a bounded sample has often.
    """
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null").where(id_crc(F.col("id")) % 3 != 1)
    counted = durable(known.groupBy("lang").count())
    # One row for each language that occurs.
    counts = [(r.lang, r["count"]) for r in counted.orderBy(F.desc("count"), "lang").collect()]
    if not counts:
        return LanguageFilter.build([], [], UNKNOWN)
    most = counted.select("lang", (F.least(F.lit(1.0), sample / F.col("count")) * (1 << 30)).cast("long").alias("most"))
    most = F.broadcast(most) if len(counts) <= BROADCAST_LANGUAGES else most
    chosen = known.join(most, "lang").where(F.pmod(F.xxhash64(F.lit("language"), "lang", "id"), F.lit(1 << 30)) < F.col("most"))

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, part in b.groupby("lang"):
                for _, texts in blocks(clean(part["text"])):
                    h, n = np.unique(grams(texts)[0], return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": h.view(np.int64), "n": n})

    table = chosen.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = durable(table)
    totals = table.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = F.broadcast(totals) if len(counts) <= BROADCAST_LANGUAGES else totals
    shared = table.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shared.groupBy("gram").agg(F.max("share").alias("top"))
    member = shared.where(F.col("n") * ONE_IN >= F.col("total")).join(top, "gram").where(F.col("share") >= F.col("top") * LEAST_SHARE)
    found = member.select("lang", "gram").toPandas()
    languages = sorted(name for name, _ in counts)
    by = dict(iter(found.groupby("lang")["gram"]))
    members = [by[name].to_numpy().view(np.uint64) if name in by else np.empty(0, np.uint64) for name in languages]
    return LanguageFilter.build(languages, members, counts[0][0])


def predict_language(model: LanguageFilter, text: Column) -> Column:
    """struct(lang_pred, score) of a text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            texts = list(t)
            found = [x for i in range(0, len(texts), TOGETHER) for x in model.predict(texts[i : i + TOGETHER])]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def language_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs.

    A text that is null or has no letter is ``und`` with score 0, as all are if nothing can be learned; a text
    without any known n-gram gets the language with the most texts and score 0; equal counts go to the name
    that sorts first. A null doc_id counts as the empty text in the split; repeated rows each give a row;
    an empty table gives no rows; other columns are ignored.
    """
    model = fit_languages(docs, doc_id, text, lang, **options)
    out = docs.select(F.col(doc_id).alias("doc_id"), predict_language(model, F.col(text)).alias("p"))
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "p.lang_pred", "p.score")
