"""Gradient-boosted regression trees on histograms, many models in the same passes.

Features are binned once at quantile edges.  Rows that agree in all bins and in the models they
train count as one cell with their number, mean and spread of the target: trees cannot tell them
apart, so nothing is lost, and with few features cells stay few however many rows there are.

A tree grows level by level.  One pass adds up, per (model, node, feature, bin), how many rows
there are and the sum of their residuals; these histograms are all that leaves the executors.
All models, such as those of cross-validation folds and of a hold-out split, share every pass.
The cells' predictions stay on the executors; every ``SAVED`` trees they are saved to the checkpoint
folder.

A split needs rows on both sides; of equally good splits (to rounding) the first feature and
then the smallest edge wins.  Null features count as zero; rows with a null target are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.functions.cuts import border_rows
from usagelens.workspace import allow_rdd_checkpoints, materialise, workers_import

#: Bins per feature; trees between saved predictions; partitions added without a tree.
BINS, SAVED, DIRECT = 256, 25, 64
#: Gains that differ by less are equal; a gain this small against its parts is none.
TIE, NOTHING = 1e-9, 1e-12
#: Models of one training: bits of a long.
MOST = 62

NODES = "model int, tree int, node int, feature string, threshold double, value double"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def quantile_edges(df: DataFrame, feature: str, key: str, bins: int) -> np.ndarray:
    """Distinct values at ranks n i / bins, each the last of its bin."""
    borders = border_rows(df, _filled(feature), F.col(key),
                          lambda n: sorted({-(-n * i // bins) for i in range(1, bins)}))
    return np.unique([b.value for b in borders]).astype("f8")


@dataclass(frozen=True)
class Tree:
    """Nodes by heap number: 1 is the root, the children of i are 2i and 2i + 1."""

    splits: dict[int, tuple[int, float]]
    values: dict[int, float]


@dataclass(frozen=True)
class Boosted:
    """An additive model: a start value and trees whose leaves already hold the learning rate."""

    features: tuple[str, ...]
    start: float
    trees: tuple[Tree, ...]

    def prediction(self) -> Column:
        """The model as one expression, without any UDF."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + self._branch(tree, 1)
        return total

    def _branch(self, tree: Tree, node: int) -> Column:
        if node not in tree.splits:
            return F.lit(tree.values[node])
        feature, threshold = tree.splits[node]
        return F.when(_filled(self.features[feature]) <= threshold, self._branch(tree, 2 * node)) \
            .otherwise(self._branch(tree, 2 * node + 1))

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, self.prediction())

    def rows(self, model: int = 0) -> list[tuple]:
        """The nodes as rows of ``NODES``; tree -1 holds the start value."""
        out: list[tuple] = [(model, -1, 1, None, None, self.start)]
        for t, tree in enumerate(self.trees):
            out += [(model, t, n, self.features[f], x, None) for n, (f, x) in tree.splits.items()]
            out += [(model, t, n, None, None, v) for n, v in tree.values.items()]
        return out

    def as_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.as_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def of_rows(cls, rows: Iterable) -> Boosted:
        """From rows of ``NODES`` of one model."""
        rows = list(rows)
        features = tuple(sorted({r.feature for r in rows if r.feature is not None}))
        splits, values, start = {}, {}, 0.0
        for r in rows:
            if r.tree < 0:
                start = r.value
            elif r.feature is None:
                values.setdefault(r.tree, {})[r.node] = r.value
            else:
                splits.setdefault(r.tree, {})[r.node] = (features.index(r.feature), r.threshold)
        return cls(features, start, tuple(Tree(splits.get(t, {}), values[t]) for t in sorted(values)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        return cls.of_rows(spark.read.schema(NODES).parquet(path).collect())


@dataclass(frozen=True)
class Block:
    """Cells as columns: bins of the features, models trained, rows, mean and spread of the
    target, and the prediction of every model."""

    bins: np.ndarray
    trains: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    guess: np.ndarray


def _cells(df: DataFrame, features: Sequence[str], target: str, edges: list[np.ndarray],
           members: Sequence[Column]) -> DataFrame:
    """``b0, b1, ..., trains, n, mean, spread``; ``members`` say which rows a model trains on."""
    mask = sum((F.when(m, F.lit(1 << i)).otherwise(0).cast("long") for i, m in enumerate(members)),
               F.lit(0).cast("long"))
    names = [f"b{i}" for i in range(len(features))]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(np.searchsorted(e, c.to_numpy(zero_copy_only=False)).astype("i4"))
                     for e, c in zip(edges, batch.columns)]
            yield pa.RecordBatch.from_arrays([*found, *batch.columns[len(edges):]],
                                             names=[*names, "trains", "y"])

    rows = df.where(F.col(target).isNotNull()).select(
        *[_filled(f).alias(n) for f, n in zip(features, names)], mask.alias("trains"),
        F.col(target).cast("double").alias("y"))
    shape = ", ".join(f"{n} int" for n in names) + ", trains long, y double"
    return rows.mapInArrow(binned, shape).groupBy(*names, "trains").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"),
        (F.var_pop("y") * F.count("*")).alias("spread"))


def _blocks(rows: Iterable, d: int, n_models: int) -> Iterator[Block]:
    rows = list(rows)  # the cells of one partition
    if rows:
        table = np.array([tuple(r) for r in rows], "f8")
        yield Block(table[:, :d].astype("i4"), np.array([r.trains for r in rows], "i8"), table[:, d + 1],
                    table[:, d + 2], table[:, d + 3], np.zeros((len(rows), n_models)))


@dataclass(frozen=True)
class Grown:
    """A tree in bins while it grows: split nodes and leaf values."""

    cuts: dict[int, tuple[int, int]]
    values: dict[int, float]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that every cell has reached."""
        at = np.ones(len(bins), "i8")
        for node, (feature, cut) in sorted(self.cuts.items()):
            here = at == node
            at[here] = 2 * node + (bins[here, feature] > cut)
        return at

    def guesses(self, bins: np.ndarray) -> np.ndarray:
        nodes, out = self.nodes(bins), np.zeros(len(bins))
        for node, value in self.values.items():
            out[nodes == node] = value
        return out


def _added(parts: RDD) -> np.ndarray:
    n = parts.getNumPartitions()
    return parts.treeReduce(np.add, 1 if n <= DIRECT else 2 if n <= DIRECT ** 2 else 3)


def _histograms(blocks: RDD, trees: Sequence[Grown], level: int, d: int, bins: int) -> np.ndarray:
    """Rows and residual sums by model, node of the level, feature and bin."""
    first, width = 1 << level, 1 << level

    def partial(found: Iterable[Block]) -> Iterator[np.ndarray]:
        out = np.zeros((len(trees), width, d, bins, 2))
        for b in found:
            for m, tree in enumerate(trees):
                node = tree.nodes(b.bins) - first
                here = np.flatnonzero((b.trains >> m & 1).astype(bool) & (node >= 0))
                n, node = b.n[here], node[here]
                rest = n * (b.mean[here] - b.guess[here, m])
                for f in range(d):
                    place = node * bins + b.bins[here, f]
                    for i, weight in enumerate((n, rest)):
                        out[m, :, f, :, i] += np.bincount(place, weight, width * bins).reshape(
                            width, bins)
        yield out

    return _added(blocks.mapPartitions(partial))


def best_split(histogram: np.ndarray) -> tuple[int, int, list[float]] | None:
    """Feature, last bin of the left side and the mean residual of both sides for one node,
    from its (feature, bin, [rows, residuals]); none if no split gains anything."""
    left = np.cumsum(histogram, axis=1)[:, :-1]
    whole = histogram[0].sum(axis=0)
    right = whole - left
    possible = (left[..., 0] > 0.5) & (right[..., 0] > 0.5)
    if not possible.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0]
    gain = np.where(possible, parts - whole[1] ** 2 / whole[0], -np.inf)
    top = gain.max()
    if not top > NOTHING * parts[possible].max():
        return None
    feature, cut = map(int, np.argwhere(gain >= top * (1 - TIE))[0])
    a, b = left[feature, cut], right[feature, cut]
    return feature, cut, [float(a[1] / a[0]), float(b[1] / b[0])]


@dataclass(frozen=True)
class Training:
    """Fitted models, and per model the rows and root mean square error on rows it does not
    train on."""

    models: list[Boosted]
    unseen_rows: list[int]
    unseen_rmse: list[float | None]


def boost(df: DataFrame, features: Sequence[str], target: str, key: str,
          members: Mapping[str, Column] | Sequence[Column], n_trees: int = 100, rate: float = 0.1,
          depth: int = 3, bins: int = BINS) -> Training:
    """Fit one model per entry of ``members``, the condition for a row to train it."""
    members = list(members.values() if isinstance(members, Mapping) else members)
    if not 0 < len(members) <= MOST:
        raise ValueError(f"between 1 and {MOST} models can be trained together")
    spark, d, n_models = df.sparkSession, len(features), len(members)
    workers_import(spark)
    allow_rdd_checkpoints(spark)
    edges = [quantile_edges(df, f, key, bins) for f in features]
    stored = materialise(_cells(df, features, target, edges, members), "cells")
    blocks = stored.rdd.mapPartitions(lambda rows: _blocks(rows, d, n_models))

    def totals(found: Iterable[Block]) -> Iterator[np.ndarray]:
        out = np.zeros((n_models, 2))
        for b in found:
            for m in range(n_models):
                n = b.n * (b.trains >> m & 1)
                out[m] += n.sum(), (n * b.mean).sum()
        yield out

    whole = _added(blocks.mapPartitions(totals))
    if not (whole[:, 0] > 0).all():
        raise ValueError("a model has no rows to train on")
    starts = whole[:, 1] / whole[:, 0]
    grown: list[list[Grown]] = []
    state, step = _started(blocks, starts).persist(StorageLevel.MEMORY_AND_DISK), None
    n_bins = max(len(e) for e in edges) + 1
    try:
        for t in range(n_trees):
            trees = [Grown({}, {}) for _ in members]
            for level in range(depth):
                found = _histograms(state, trees, level, d, n_bins)
                if step is not None:  # the new predictions are in use, the old ones are not
                    step.unpersist()
                    step = None
                for m, tree in enumerate(trees):
                    _grow(tree, found[m], 1 << level, rate)
                if not any(node >> level for tree in trees for node in tree.cuts):
                    break
            grown.append(trees)
            step, state = state, _advanced(state, trees).persist(StorageLevel.MEMORY_AND_DISK)
            if t % SAVED == SAVED - 1:
                state.checkpoint()
        n, error = _unseen(state, n_models)
    finally:
        for held in (state, step):
            if held is not None:
                held.unpersist()
    models = [Boosted(tuple(features), float(starts[m]), tuple(
        _named(trees[m], edges) for trees in grown)) for m in range(n_models)]
    return Training(models, [int(x) for x in n],
                    [float(np.sqrt(e / x)) if x else None for x, e in zip(n, error)])


def _grow(tree: Grown, histograms: np.ndarray, first: int, rate: float) -> None:
    """Split the nodes of a level; a node that is not split keeps its value."""
    for i, histogram in enumerate(histograms):
        node, (rows, rest) = first + i, histogram[0].sum(axis=0)
        if rows < 0.5:
            continue
        found = best_split(histogram)
        if found is None:
            tree.values[node] = rate * float(rest / rows)
            continue
        feature, cut, means = found
        tree.cuts[node] = (feature, cut)
        tree.values.pop(node, None)
        tree.values.update({2 * node: rate * means[0], 2 * node + 1: rate * means[1]})


def _named(tree: Grown, edges: list[np.ndarray]) -> Tree:
    return Tree({n: (f, float(edges[f][cut])) for n, (f, cut) in tree.cuts.items()}, tree.values)


def _started(blocks: RDD, starts: np.ndarray) -> RDD:
    return blocks.map(lambda b: Block(b.bins, b.trains, b.n, b.mean, b.spread, b.guess + starts))


def _advanced(blocks: RDD, trees: Sequence[Grown]) -> RDD:
    return blocks.map(lambda b: Block(
        b.bins, b.trains, b.n, b.mean, b.spread,
        b.guess + np.stack([t.guesses(b.bins) for t in trees], axis=1)))


def _unseen(blocks: RDD, n_models: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared errors of every model over cells that it did not train on."""
    def partial(found: Iterable[Block]) -> Iterator[np.ndarray]:
        out = np.zeros((2, n_models))
        for b in found:
            for m in range(n_models):
                out_of = (b.trains >> m & 1) == 0
                off = b.mean - b.guess[:, m]
                out[0, m] += b.n[out_of].sum()
                out[1, m] += (b.spread + b.n * off * off)[out_of].sum()
        yield out

    n, error = _added(blocks.mapPartitions(partial))
    return n, error
