"""Quality classifier: an ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade > k) = sigmoid(w.x - t_k): one weight vector w, shared by all grades, and ordered thresholds t_0 < t_1 < ... A text's
features are the hashes of its words and of their last three bytes, each present once, scaled to unit length. The regression is
fitted on a bounded sample of the rated rows, those of the smallest hash of their id, and then scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage, unused
from .textnp import Words, batches_of, mix64

BITS = 20
#: Rated rows that the regression is fitted on at most (documented bound; the model is far smaller than what they teach).
SAMPLE = 12_000
#: Bytes of their features that the driver fetches at most (4 a feature): rows beyond teach nothing.
SAMPLE_BYTES = 64 << 20


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a batch, text after text, and where each text's begin."""
    w = Words(texts)
    n = len(w.doc) - 1
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    tail = np.zeros(len(w.start), np.uint64)
    for back in (3, 2, 1):
        at = w.end - back
        tail = tail << np.uint64(8) | np.where(at >= w.start, w.buf[np.maximum(at, 0)], 0).astype(np.uint64)
    doc = np.repeat(np.arange(n), np.diff(w.doc)).astype(np.uint64)
    mask = np.uint64((1 << BITS) - 1)
    both = np.concatenate([doc << np.uint64(BITS) | (w.hash & mask), doc << np.uint64(BITS) | (mix64(tail + np.uint64(0x7A11)) & mask)])
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both & mask).astype(np.int64), np.searchsorted(both >> np.uint64(BITS), np.arange(n + 1, dtype=np.uint64))


def _apart(thresholds: np.ndarray, least: float = 0.1) -> np.ndarray:
    """Thresholds in order with at least ``least`` between them: where two meet, the likelihood of the grade between vanishes."""
    shift = least * np.arange(len(thresholds))
    return np.maximum.accumulate(thresholds - shift) + shift


class Ordinal:
    """Weights and thresholds; ``fit`` climbs the full gradient of the mean log-likelihood, with Nesterov's momentum."""

    def __init__(self, grades: int):
        self.weights, self.thresholds = np.zeros(1 << BITS), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -60, 60)))

    def fit(self, at: np.ndarray, rows: np.ndarray, grade: np.ndarray, steps: int = 120, rate: float = 4.0, ridge: float = 1e-5, least: int = 4) -> "Ordinal":
        """Features of fewer than ``least`` texts get no weight; the others step by the root of how rare they are.

        Grades weigh alike however often they occur. After each step thresholds are put in order, a little apart.
        """
        n, k = len(grade), len(self.thresholds)
        size = np.diff(rows)
        scale = 1 / np.sqrt(np.maximum(size, 1))
        count = np.bincount(at, minlength=1 << BITS)
        often = count[at] >= least
        of, (used, at) = np.repeat(np.arange(n), size)[often], np.unique(at[often], return_inverse=True)
        pace = rate * np.sqrt(n / count[used])
        balance = 1 / np.maximum(np.bincount(grade, minlength=k + 1), 1)[grade]
        balance /= balance.sum()
        w = ahead = np.zeros(len(used))
        t = t_ahead = self.thresholds
        momentum = 1.0
        for _ in range(steps):
            self.thresholds = t_ahead
            p = np.hstack([np.ones((n, 1)), self.tails(np.bincount(of, ahead[at], n) * scale), np.zeros((n, 1))])
            upper, lower = p[np.arange(n), grade], p[np.arange(n), grade + 1]
            like = np.maximum(upper - lower, 1e-12)
            gu, gl = upper * (1 - upper) / like * balance, lower * (1 - lower) / like * balance
            g = np.bincount(at, ((gu - gl) * scale)[of], len(used)) - ridge * ahead
            gt = np.zeros(k)
            np.add.at(gt, grade[grade > 0] - 1, -gu[grade > 0])
            np.add.at(gt, grade[grade < k], gl[grade < k])
            new, t_new, after = ahead + pace * g, _apart(t_ahead + gt), (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            ahead, t_ahead = new + (momentum - 1) / after * (new - w), _apart(t_new + (momentum - 1) / after * (t_new - t))
            w, t, momentum = new, t_new, after
        self.weights[used], self.thresholds = w, t
        return self

    def score(self, texts) -> np.ndarray:
        at, rows = features(texts)
        size = np.diff(rows)
        of = np.repeat(np.arange(len(size)), size)
        return np.bincount(of, self.weights[at], len(size)) / np.sqrt(np.maximum(size, 1))


@F.pandas_udf(T.BinaryType())
def _features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        out = []
        for piece in batches_of(s):
            at, rows = features(piece)
            out += [at[a:b].astype(np.int32).tobytes() for a, b in zip(rows, rows[1:], strict=False)]
        yield pd.Series(out)


def learn(rated: DataFrame, grades: int, sample: int = SAMPLE) -> Ordinal:
    """``rated``: ``doc_id, text, grade`` (0 to grades - 1). Rows with a null text or grade teach nothing.

    The sample is that of the smallest hashes of id and text; rows of equal hash are repeats of one another, and it does not matter
    which are in. A table without rated rows gives a model without weights.
    """
    small_batches(rated.sparkSession)
    order = F.xxhash64("doc_id", "text")
    chosen = rated.where("text is not null and grade is not null").withColumn("place", order).orderBy("place").limit(sample)
    chosen = stage(chosen.select("place", "grade", _features("text").alias("at")), "rated")
    upto = F.sum(F.octet_length("at").cast("long")).over(Window.orderBy("place", "grade").rowsBetween(Window.unboundedPreceding, 0))
    rows = chosen.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("grade", "at").collect()  # at most SAMPLE_BYTES
    model = Ordinal(grades)
    if rows:
        sizes = np.cumsum([0] + [len(r["at"]) // 4 for r in rows])
        model.fit(np.concatenate([np.frombuffer(r["at"], np.int32).astype(np.int64) for r in rows]), sizes, np.array([r["grade"] for r in rows]))
    return model


def scorer(model: Ordinal, spark):
    """A column function: struct of expected_grade and tails, the probabilities that the grade exceeds 0, 1, ..."""
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade:double,tails:array<double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for s in parts:
            tails = np.concatenate([own.tails(own.score(piece)) for piece in batches_of(s)]) if len(s) else np.zeros((0, len(own.thresholds)))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tails": list(tails)})

    return run


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating from the two marks: 0 toxic, 1 poor, 2 good; null if a mark that decides is null."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def classify(docs: DataFrame, rated: DataFrame, grades: int = 3, least_tail: float = 0.4, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to grades - 1), ``tail`` (probability of the best grade) and ``kept`` (tail >= least_tail).

    A null or empty text has no features: its score is 0 and the thresholds alone decide. Texts are read whole. Rows of ``rated``
    that repeat count as often as they occur. Columns of ``docs`` named like ours are replaced, all others stay.
    """
    model = scorer(learn(rated, grades), docs.sparkSession)
    small_batches(docs.sparkSession)
    name = unused(docs, "q")
    out = docs.withColumn(name, model(F.col(f"`{text}`")))
    tail = F.element_at(F.col(f"{name}.tails"), grades - 1)
    return out.withColumns({"expected_grade": F.col(f"{name}.expected_grade"), "tail": tail, "kept": tail >= least_tail}).drop(name)
