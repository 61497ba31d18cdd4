"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

Features of a text are its words and the beginnings of its words, counted.  Those that tell
toxic from other labelled texts best (likelihood ratio of document frequencies) are kept.
The model has one weight per feature, shared by all grades, and one threshold per grade:
P(grade <= k) = s(threshold_k - w x).  The expected severity is the sum of P(grade >= k).

Labels that hold only 0 and 1 are spread over grades: 0 stays, toxic texts are cut into
thirds by how much of their wording the kept features cover.  Labels with more values are
grades already.

The model is fitted on at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of their
id; every document is scored.  Null and empty texts have no features and the severity of a
text about which nothing speaks.  Null labels are ignored, repeated ones averaged.  Without
labelled texts of both kinds every severity is zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.common import stored, whole_text

TRAIN_ROWS, KEPT, LEAST_TEXTS, LEVELS = 20_000, 1_000, 4, 3
PREFIXES = (5, 6, 7)
STRIP = ".,;:!?\"'()[]{}|#$%&*<>=+-_/\\"
PENALTY, STEPS = 1.0, 300


def grams(text: str) -> Counter:
    """Words and beginnings of words with their counts."""
    found: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        word = word.strip(STRIP)
        if word:
            found[word + " "] += n
            for k in PREFIXES:
                if len(word) > k:
                    found[word[:k]] += n
    return found


@dataclass(frozen=True)
class Model:
    position: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def sparse(self, text: str) -> tuple[list[int], list[float]]:
        """Positions and values of the kept features of a text."""
        position, n, total = self.position, {}, 0
        for word, times in Counter(text.lower().split()).items():
            total += times
            word = word.strip(STRIP)
            for gram in (word + " ", *(word[:k] for k in PREFIXES if len(word) > k)):
                if gram in position:
                    at = position[gram]
                    n[at] = n.get(at, 0) + times
        room = np.sqrt(1 + total / 300)
        return list(n), [float(np.log2(1 + c) / room) for c in n.values()]

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= k) for k from 1 on."""
        at, values = self.sparse(text)
        return 1 / (1 + np.exp(self.thresholds - self.weights[at] @ np.array(values)))


def _ratio(toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    """Likelihood ratio of a feature that is more frequent in toxic texts, else zero."""
    p, q = toxic / n_toxic, other / n_other
    pooled = (toxic + other) / (n_toxic + n_other)

    def fit(x: Column, n: int, rate: Column) -> Column:
        rate = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), rate))
        return x * F.log(rate) + (n - x) * F.log(1 - rate)

    ratio = fit(toxic, n_toxic, p) + fit(other, n_other, q) - fit(
        toxic, n_toxic, pooled) - fit(other, n_other, pooled)
    return F.when(p > q, ratio).otherwise(0.0)


def _select(rows: DataFrame, n_toxic: int, n_other: int) -> list[str]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, grade in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                (toxic if grade > 0 else other).update(grams(text).keys())
        names = list(toxic.keys() | other.keys())
        for i in range(0, len(names), 10_000):
            part = names[i:i + 10_000]
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array(part, pa.string()),
                "toxic": pa.array([toxic[g] for g in part], pa.int64()),
                "other": pa.array([other[g] for g in part], pa.int64())})

    table = rows.mapInArrow(counted, "gram string, toxic long, other long").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    best = (table.where(F.col("toxic") >= LEAST_TEXTS)
            .select("gram", _ratio(F.col("toxic"), F.col("other"), n_toxic, n_other).alias("r"))
            .where("r > 4").orderBy(F.desc("r"), "gram").limit(KEPT))
    return [r["gram"] for r in best.collect()]


def ordinal(x: tuple[np.ndarray, np.ndarray, np.ndarray], grade: np.ndarray, n_features: int,
            levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated full-batch gradient steps.

    ``x`` holds row, column and value of each entry.  Thresholds are a first one and positive
    gaps, so they stay in order.
    """
    row, column, value = x
    n = len(grade)
    gap = np.array([-4.0, *[0.0] * (levels - 1)])
    state = np.concatenate([np.zeros(n_features), gap])
    state[n_features] = np.log((grade == 0).mean() / max((grade > 0).mean(), 1e-9))
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        w, free = state[:n_features], state[n_features:]
        theta = np.cumsum([free[0], *np.logaddexp(0, free[1:])])
        z = np.bincount(row, value * w[column], n)
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = ends[grade + 1] - z, ends[grade] - z
        s_up, s_low = 1 / (1 + np.exp(-upper)), 1 / (1 + np.exp(-lower))
        mass = np.maximum(s_up - s_low, 1e-12)
        d_up, d_low = s_up * (1 - s_up) / mass, s_low * (1 - s_low) / mass
        g_z = d_up - d_low
        g_theta = np.array([d_low[grade == k + 1].sum() - d_up[grade == k].sum()
                            for k in range(levels)])
        later = np.cumsum(g_theta[::-1])[::-1]
        g_free = np.concatenate([later[:1], later[1:] / (1 + np.exp(-free[1:]))])
        g = np.concatenate([np.bincount(column, value * g_z[row], n_features) + PENALTY * w,
                            g_free]) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        state = state - 0.1 * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    free = state[n_features:]
    return state[:n_features], np.cumsum([free[0], *np.logaddexp(0, free[1:])])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic",
        train_rows: int = TRAIN_ROWS) -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.avg(label).alias("label"))
    step = max(1, -(-known.count() // train_rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    rows = stored(documents.select("doc_id", whole_text().alias("text")).join(known, "doc_id")
                  .select("text", "label"), "labelled")
    n, n_toxic, most = rows.agg(F.count("*"), F.count_if(F.col("label") > 0),
                                F.max("label")).first()
    silent = Model({}, np.zeros(0), np.full(LEVELS, 50.0))
    if not n_toxic or n_toxic == n:
        return silent
    kept = _select(rows, n_toxic, n - n_toxic)
    model = Model({g: i for i, g in enumerate(kept)}, np.zeros(len(kept)), np.zeros(LEVELS))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [model.sparse(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "label": batch["label"],
                "at": pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
                "value": pa.array([p[1] for p in pairs], pa.list_(pa.float64()))})

    sample = rows.mapInArrow(sparse, "label double, at array<int>, value array<double>").collect()
    sizes = [len(r["at"]) for r in sample]
    x = (np.repeat(np.arange(len(sample)), sizes),
         np.fromiter((i for r in sample for i in r["at"]), "i8", sum(sizes)),
         np.fromiter((v for r in sample for v in r["value"]), "f8", sum(sizes)))
    y = np.array([r["label"] for r in sample])
    levels = LEVELS if most <= 1 else int(np.ceil(most))
    if most <= 1:
        amount = np.bincount(x[0], x[2], len(sample))
        cuts = np.quantile(amount[y > 0], np.arange(1, LEVELS) / LEVELS)
        grade = np.where(y > 0, 1 + np.searchsorted(cuts, amount, "right"), 0)
    else:
        grade = np.rint(y).astype("i8")
    return Model(model.position, *ordinal(x, grade, len(kept), levels))


def severity(text: Column, model: Model) -> Column:
    """Expected severity and the probability of any, as a struct."""
    shape = pa.struct([("severity", pa.float64()), ("probability", pa.float64())])

    @F.arrow_udf("struct<severity:double,probability:double>")
    def expected(texts: pa.Array) -> pa.Array:
        found = [model.at_least(t or "") for t in texts.to_pylist()]
        return pa.array([{"severity": float(p.sum()), "probability": float(p[0])}
                         for p in found], shape)

    return expected(text)


def grade_documents(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``doc_id, severity, probability, toxic`` of every document."""
    model = fit(documents, labels, label)
    graded = documents.select("doc_id", severity(F.col("text"), model).alias("g"))
    return graded.select("doc_id", "g.severity", "g.probability",
                         (F.col("g.probability") >= 0.5).cast("int").alias("toxic"))
