"""Toxic passages by maximum-scoring segments over token log-odds.

Learning: log-odds, with an informative Dirichlet prior, of words and of their beginnings between toxic and
other labelled documents. A token scores the log-odds of its most telling unit less a
drift, and minus the drift where no unit is significant. Every maximal segment of a text is found in one
pass. The expected number of as good segments in clean text of that length follows the extreme-value law of
segment scores, whose decay is computed from the scores of clean tokens; a segment is a significant passage by
that number alone. The numbers of segments are Poisson by the same law, so that the r best segments together
have a tail probability; the least one over all r is the document's evidence, and a logistic curve turns it
into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossator.llm.common import durable, id_crc, lots, worker_cache

#: Labelled documents that the model is fitted on, at most; a hash of the id chooses them.
SAMPLE = 20_000
#: Words that count as features of the sample, at least in so many of its documents.
LEAST_DOCS = 3
#: Lengths of the beginnings that are units besides the word.
BEGINNINGS = range(3, 13)
PRIOR, LEAST_PRIOR = 500.0, 0.5
LEAST_Z, LEAST_ODDS = 3.0, 1.5
DRIFT = 0.5
#: Expected number of as good segments in clean text up to which a passage is significant.
SIGNIFICANT = 0.01
#: Scale of the extreme-value law; the decay is fitted, and a constant factor is left to the logistic curve.
SCALE = 0.1
#: Words that a worker remembers the scores of, and texts that it counts words of together.
REMEMBERED, COUNTED = 150_000, 500
WORDS = re.compile(r"[^\W\d_]+").findall


def units(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if n < len(word))]


def poisson_tail(r: int, mean: float) -> float:
    """-log10 of the probability of r events or more."""
    if mean >= r:
        return 0.0
    term = total = 1.0
    for i in range(1, 60):
        term *= mean / (r + i)
        total += term
    return max(0.0, (mean - r * math.log(mean) + math.lgamma(r + 1) - math.log(total)) / math.log(10))


def segments(positions: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a sequence that has ``scores`` at
    ``positions`` and minus ``drift`` elsewhere; linear in the number of positions.

    Each candidate knows the nearest one below it whose sum before its first token is less. Those in between
    have greater sums, so a search that goes on past it never looks at them again.
    """
    first, last, low, high, below = [], [], [], [], []  # the stack of candidates; below is an index or -1
    total, at = 0.0, 0
    for p, s in zip(positions.tolist(), scores.tolist(), strict=True):
        total -= drift * (p - at)
        a, lo, hi = p, total, total + s
        total, at = hi, p + 1
        k = len(low) - 1
        while True:
            while k >= 0 and low[k] >= lo:
                k = below[k]
            if k < 0 or high[k] >= hi:
                break
            a, lo, cut, k = first[k], low[k], k, below[k]  # joined with all candidates from the k-th on
            for column in (first, last, low, high, below):
                del column[cut:]
        for column, value in zip((first, last, low, high, below), (a, p, lo, hi, k), strict=True):
            column.append(value)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high, strict=True)]


class Memo(dict):
    """Word to score, computed once; emptied when it is large."""

    def __init__(self, odds: dict[str, float], drift: float):
        super().__init__()
        self.odds, self.drift = odds, drift

    def __missing__(self, word: str) -> float:
        found = [self.odds[u] for u in units(word) if u in self.odds]
        score = max(found) - self.drift if found else -self.drift
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = score
        return score


@dataclass
class ToxicityModel:
    """What is learned: log-odds of units, decay of segment scores in clean text, and the logistic curve."""

    odds: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    intercept: float = -5.0
    slope: float = 1.0

    def memo(self) -> Memo:
        held = worker_cache("toxicity").get("toxicity")
        if held is None or held[0] != self.key():
            held = worker_cache("toxicity")["toxicity"] = (self.key(), Memo(self.odds, DRIFT))
        return held[1]

    def key(self) -> tuple:
        return len(self.odds), sum(self.odds.values())

    def found(self, text: str | None) -> list[tuple[int, int, float]]:
        """All maximal segments: first token, last token, natural logarithm of the expected number."""
        score, places, values, n = self.memo().__getitem__, [], [], 0
        for piece in lots((text or "").lower()):
            tokens = WORDS(piece)
            scores = np.fromiter(map(score, tokens), np.float64, len(tokens))
            at = np.flatnonzero(scores > 0)
            places.append(at + n)
            values.append(scores[at])
            n += len(tokens)
        if not n:
            return []
        size = math.log(SCALE * n)
        return [(a, b, size - self.decay * s) for a, b, s in segments(np.concatenate(places), np.concatenate(values), DRIFT)]

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant segments: first token, last token, -log10 of the expected number."""
        return [(a, b, -e / math.log(10)) for a, b, e in self.found(text) if e <= math.log(SIGNIFICANT)]

    def evidence(self, text: str | None) -> float:
        expected = sorted(e for _, _, e in self.found(text))
        return math.log1p(max((poisson_tail(r, math.exp(max(e, -600.0))) for r, e in enumerate(expected, 1)), default=0.0))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def decay_of(scores: Counter) -> float:
    """The positive root of sum p(s) exp(decay * s) = 1 over the scores of clean tokens; the best score that any
    unit has counts once more, so that there is one."""
    s = np.array(list(scores), float)
    p = np.array(list(scores.values()), float)
    p /= p.sum()
    low, high = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton steps."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """text and label of at most about ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(id_crc(F.col("id")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # Bounded by the sample: a few bytes a row.
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select("text", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fits the model on labelled documents with crc32(id) mod 5 other than 0, SAMPLE of them at most.

    Without labels of both kinds the model finds nothing toxic. The units that come to the driver are the
    significant ones of a bounded sample.
    """
    train = durable(training_sample(docs, labels, doc_id, text, label, sample))
    size = train.agg(F.count("*"), F.sum("y")).first()
    if not size[0] or not size[1] or size[0] == size[1]:
        return ToxicityModel(intercept=-5.0 if not size[1] else 5.0, slope=0.0)

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b.iloc[i : i + COUNTED] for b in batches for i in range(0, len(b), COUNTED)):
            counts: dict[str, list[int]] = {}
            for t, y in zip(b["text"], b["y"], strict=True):
                for w in set(WORDS((t or "").lower())):
                    c = counts.setdefault(w, [0, 0])
                    c[y] += 1
            yield pd.DataFrame([(w, *c) for w, c in counts.items()], columns=["word", "clean", "toxic"])

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for w, clean, toxic in zip(b["word"], b["clean"], b["toxic"], strict=True):
                for u in units(w):
                    c = counts.setdefault(u, [0, 0])
                    c[0] += clean
                    c[1] += toxic
            yield pd.DataFrame([(u, *c) for u, c in counts.items()], columns=["unit", "clean", "toxic"])

    by_word = train.mapInPandas(words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    by_unit = durable(by_word.mapInPandas(split, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    n_clean, n_toxic, n_units = by_unit.agg(F.sum("clean"), F.sum("toxic"), F.count("*")).first()
    # The prior: PRIOR pseudo-counts dealt out as the unit is in all of the sample, and LEAST_PRIOR for each unit.
    prior = LEAST_PRIOR + (F.col("clean") + F.col("toxic")) * (PRIOR / (n_clean + n_toxic))
    weight = PRIOR + LEAST_PRIOR * n_units
    side = lambda c, n: F.log((F.col(c) + prior) / (float(n) + weight))
    odds = side("toxic", n_toxic) - side("clean", n_clean)
    z = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    telling = by_unit.where(F.col("toxic") >= LEAST_DOCS).select("unit", odds.alias("odds"), z.alias("z")).where((F.col("odds") >= LEAST_ODDS + DRIFT) & (F.col("z") >= LEAST_Z))
    model = ToxicityModel(odds={r.unit: r.odds for r in telling.collect()})
    if not model.odds:
        return ToxicityModel(intercept=math.log(size[1] / (size[0] - size[1])), slope=0.0)

    def score_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            memo, counts = model.memo(), Counter()
            for t in b["text"]:
                counts.update(round(memo[w], 1) for w in WORDS((t or "").lower()))
            yield pd.DataFrame(list(counts.items()), columns=["score", "n"])

    clean = train.where("y = 0").mapInPandas(score_counts, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    counts = Counter({r.score: r.n for r in clean})
    counts[round(max(model.odds.values()) - DRIFT, 1)] += 1
    model.decay = decay_of(counts)

    def evidence(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [model.evidence(t) for t in b["text"]], "y": b["y"]})

    points = train.mapInPandas(evidence, "x double, y int").toPandas()
    model.intercept, model.slope = logistic(points["x"].to_numpy(), points["y"].to_numpy(float))
    return model


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Probability that a text is labelled toxic."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([model.probability(model.evidence(x)) for x in t], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(text)


def toxicity_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts have no evidence and the score that goes with it; a null doc_id counts as the empty
    text in the split and is held out; repeated rows each give a row; an empty table gives no rows; null
    labels are not learned from, and a document with several labels is toxic if one says so.
    """
    model = fit_toxicity(docs, labels, doc_id, text, **options)
    scored = docs.select(F.col(doc_id).alias("doc_id"), toxicity_score(model, F.col(text)).alias("score"))
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxic_passages(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first and last token and -log10 expected number of every significant passage."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *p) for d, t in zip(b["doc_id"].astype("Int64"), b["text"], strict=True) for p in model.passages(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "first", "last", "evidence"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, first int, last int, evidence double")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns."""
    model = fit_toxicity(docs, labels, text=text, **options)
    return docs.where(toxicity_score(model, F.col(text)) < 0.5)
