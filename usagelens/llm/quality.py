"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

``statistics`` describes each whole text by a few numbers (lengths, shares of character
classes, repetition).  Standardised, they are mapped to cosines of random projections, whose
inner products approximate a Gaussian kernel.  Ridge regression of the label on them needs
only two sums over the labelled rows, which partitions add up on their own; a few summed
blocks of fixed size reach the driver.  Isotonic regression over a fixed grid of raw scores
turns the ridge output into a probability.

All labelled rows are used, except those held out.  Labels of repeated rows are averaged;
null labels and labels without a document are ignored.  Null and empty texts have statistics
(all zero) and a score like any other.  Without labels every score is 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.common import stored

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()",
            b"!?", b"#$%&*+/<=>@[\\]^_`{|}~"]
#: Row per class of characters, column per byte.
_CLASS_OF = np.array([[float(b in c) for b in range(256)] for c in _CLASSES])
N_STATISTICS = 19
FEATURES, RIDGE, SEED = 256, 1e-3, 11
#: Summed blocks that reach the driver, at most; cells of the grid of raw scores per unit.
BLOCKS, GRID = 16, 500


def statistics_of(text: str) -> list[float]:
    """Nineteen numbers about a text; all zero for one without words."""
    data, words = text.encode(), text.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, size = len(words), len(data)
    shares = _CLASS_OF @ np.bincount(np.frombuffer(data, "u1"), minlength=256) / size
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = text.split("\n")
    total = max(1, n - 1)
    bare = sum(c for w, c in counts.items() if not w[-1].isalnum())
    long = sum(c for w, c in counts.items() if len(w) > 20)
    upper = sum(c for w, c in counts.items() if w.isupper())
    return [math.log1p(len(text)), math.log1p(n), len(text) / n, *map(math.sqrt, shares),
            math.log(len(counts)) / math.log(n + 1), counts.most_common(1)[0][1] / n,
            sum(c - 1 for c in pairs.values()) / total,
            max(pairs.values(), default=0) / total,
            1 - len(set(lines)) / len(lines), math.log1p(len(text) / len(lines)),
            bare / n, long / n, upper / n]


def statistics(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array([statistics_of(t or "") for t in texts.to_pylist()],
                        pa.list_(pa.float64()))

    return numbers(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]

    @property
    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        return (rng.normal(size=(N_STATISTICS, FEATURES)) / math.sqrt(N_STATISTICS),
                rng.uniform(0, 2 * math.pi, FEATURES))

    def features(self, numbers: np.ndarray) -> np.ndarray:
        """Cosine features and a constant one."""
        w, b = self.projection
        z = np.clip((numbers - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ w + b) * math.sqrt(2 / FEATURES),
                                np.ones(len(numbers))])

    def raw(self, numbers: np.ndarray) -> np.ndarray:
        return self.features(numbers) @ self.weights

    def score(self, numbers: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw one keeps the order on flat steps."""
        if self.weights is None:
            return np.full(len(numbers), 0.5)
        raw = self.raw(numbers)
        flat = np.interp(raw, *self.knots)
        return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def isotonic(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for w, v in zip(weights, values):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(n, v) for _, v, n in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["numbers"].flatten().to_numpy().reshape(-1, N_STATISTICS)


def labelled(numbers: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``numbers, label`` of the rows a model may learn from."""
    known = (labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.avg(label).alias("label")))
    return numbers.join(known, "doc_id").select("numbers", "label")


def fit(numbers: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from ``doc_id, numbers`` and the labels of rows that are not held out."""
    rows = stored(labelled(numbers, labels, label), "labelled")
    moments = rows.select(*[F.get("numbers", F.lit(i)).alias(f"x{i}") for i in range(N_STATISTICS)]
                          ).agg(F.count("*"), *[f(f"x{i}") for f in (F.avg, F.stddev_pop)
                                                for i in range(N_STATISTICS)]).first()
    nothing = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), None, (np.zeros(1), np.zeros(1)))
    if not moments[0]:
        return nothing
    mean = np.array(moments[1:1 + N_STATISTICS])
    scale = np.array(moments[1 + N_STATISTICS:])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, nothing.knots)
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = model.features(_matrix(batch))
            total[:, :size] += x.T @ x
            total[:, size] += x.T @ batch["label"].to_numpy()
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([TaskContext.get().partitionId() % BLOCKS], pa.int64()),
            "total": pa.array([total.tobytes()], pa.binary())})

    def added(blocks: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t, "f8") for t in sorted(blocks["total"].to_pylist()))
        return pa.table({"block": blocks["block"][:1], "total": pa.array([total.tobytes()])})

    parts = (rows.mapInArrow(sums, "block long, total binary")
             .groupBy("block").applyInArrow(added, "block long, total binary")
             .orderBy("block").collect())
    total = sum(np.frombuffer(p["total"], "f8").reshape(size, size + 1) for p in parts)
    penalty = RIDGE * moments[0] * np.eye(size) / size
    penalty[-1, -1] = 0
    model = Model(model.mean, model.scale,
                  np.linalg.solve(total[:, :size] + penalty, total[:, size]), nothing.knots)
    return _calibrated(model, rows)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.clip(np.rint(model.raw(_matrix(batch)) * GRID), -GRID, 2 * GRID)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell.astype("i8")),
                                              "label": batch["label"]})

    cells = (rows.mapInArrow(raw, "cell long, label double").groupBy("cell")
             .agg(F.count("*").alias("n"), F.avg("label").alias("mean")).orderBy("cell").collect())
    n, mean = (np.array([c[k] for c in cells], "f8") for k in ("n", "mean"))
    at = np.array([c["cell"] for c in cells]) / GRID
    return Model(model.mean, model.scale, model.weights, (at, isotonic(n, mean)))


def score(numbers: Column, model: Model) -> Column:
    """The calibrated score of each row's statistics."""
    @F.arrow_udf("double")
    def scores(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)
        return pa.array(model.score(x))

    return scores(numbers)


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    numbers = stored(documents.select("doc_id", statistics(F.col("text")).alias("numbers")),
                     "statistics")
    model = fit(numbers, labels, label)
    scored = numbers.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                            score(F.col("numbers"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The documents whose score is 0.5 or more."""
    numbers = documents.select("doc_id", statistics(F.col("text")).alias("numbers"))
    model = fit(numbers, labels, label)
    return documents.where(score(statistics(F.col("text")), model) >= 0.5)
