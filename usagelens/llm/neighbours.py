"""Approximate nearest neighbours: stable projections, kd-tree cells, a chi-square stop.

Vectors are projected to ``DIMENSIONS`` Gaussian directions.  For a pair at distance d the
squared projected distance is d^2 times a chi-square variable, so once the next projected
neighbour lies so far out that a vector nearer than the k-th best found would have come
before it with probability ``CONFIDENCE``, the search ends.

A kd-tree over a bounded sample of projections (``SAMPLE`` at most and an eighth of the
vectors at most) cuts the projected space into cells; every vector is stored in its cell,
large cells in several blocks.  A query first searches its own cell, which bounds its k-th
distance, and then visits the other cells whose box passes the same test.  In a cell
candidates are verified on the original vectors in the order of projected distance until the
test stops.  Queries meet cells in blocks of bounded size.

Equal vectors are one candidate with its smallest ids, as many as a result can need.  Rows
with a null id, and vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part.  Rows equal in id and vector are one row; several
vectors of one id are several rows, each a candidate and, where asked for, a query of its own.
Equal distances are ordered by id.  Fewer candidates than ``k``: all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.llm.common import stored

DIMENSIONS, CONFIDENCE, SEED = 8, 0.99, 23
SAMPLE, CELL, QUERY_BLOCK = 16_384, 4_096, 4_096
VERIFY = 256


def chi_square_quantile(p: float, m: int) -> float:
    """For even degrees of freedom ``m``, by bisection of the closed form."""
    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * m
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


@dataclass(frozen=True)
class Cells:
    """Projection and kd-tree; a node is ``(axis, value, below, above)`` or a cell number."""

    directions: np.ndarray
    root: object
    n_cells: int

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions

    def home(self, points: np.ndarray) -> np.ndarray:
        cell, todo = np.zeros(len(points), "i8"), [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                cell[at] = node
            else:
                axis, value, below, above = node
                low = points[at, axis] <= value
                todo += [(below, at[low]), (above, at[~low])]
        return cell

    def within(self, point: np.ndarray, square: float) -> list[int]:
        """Cells whose box comes within a squared projected distance."""
        found, todo = [], [(self.root, {})]
        while todo:
            node, gaps = todo.pop()
            if isinstance(node, int):
                found.append(node)
                continue
            axis, value, below, above = node
            gap = point[axis] - value
            near, far = (below, above) if gap <= 0 else (above, below)
            todo.append((near, gaps))
            out = gaps | {axis: max(gaps.get(axis, 0.0), gap * gap)}
            if sum(out.values()) <= square:
                todo.append((far, out))
        return found


def _tree(points: np.ndarray, depth: int, number: Iterator[int]):
    spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
    if not depth or len(points) < 4 or spread.max() <= 0:
        return next(number)
    axis = int(spread.argmax())
    value = float(np.median(points[:, axis]))
    low = points[:, axis] <= value
    if low.all():
        return next(number)
    return (axis, value, _tree(points[low], depth - 1, number),
            _tree(points[~low], depth - 1, number))


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector``: the finite, non-zero vectors of the usual length."""
    sound = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    usual = sound.groupBy(F.size("vector").alias("n")).count().orderBy(
        F.desc("count"), F.desc("n")).first()
    sound = sound.where(F.size("vector") == (usual["n"] if usual else 0))
    return sound.distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """``vector, ids``: equal vectors once, with their smallest ids."""
    own = Window.partitionBy("vector").orderBy("vec_id")
    return (vectors.withColumn("n", F.row_number().over(own)).where(F.col("n") <= keep)
            .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))


def _fit(classes: DataFrame, n: int, dimensions: int) -> Cells:
    step = max(8, -(-n // SAMPLE))
    sample = [r[0] for r in classes.where(
        F.pmod(F.xxhash64("vector"), F.lit(step)) == 0).select("vector").collect()]
    size = len(classes.select("vector").first()[0])
    directions = np.random.default_rng(SEED).normal(size=(size, dimensions))
    points = np.array(sample).reshape(-1, size) @ directions
    depth = max(0, min(n // CELL, len(sample) // 8)).bit_length()
    counter = iter(range(1 << 30))
    root = _tree(points, depth, counter)
    return Cells(directions, root, next(counter))


def _placed(rows: DataFrame, cells: Cells, ids: str) -> DataFrame:
    """Rows with their projection and home cell."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = cells.project(_matrix(batch["vector"], batch.num_rows))
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype="i4") * points.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                        offsets, pa.array(points.ravel())), pa.array(cells.home(points))],
                    names=[ids, "vector", "point", "cell"])

    kind = "array<long>" if ids == "ids" else "long"
    return rows.select(ids, "vector").mapInArrow(
        place, f"{ids} {kind}, vector array<double>, point array<double>, cell long")


def best_in_block(points: np.ndarray, vectors: np.ndarray, ids: list[list[int]], query_id: int,
                  point: np.ndarray, vector: np.ndarray, k: int, bound: float, limit: float
                  ) -> list[tuple[float, int]]:
    """Distance and id of the k best rows, verified outwards until the test stops."""
    projected = ((points - point) ** 2).sum(axis=1)
    order = np.argsort(projected, kind="stable")
    best: list[tuple[float, int]] = []
    for i in range(0, len(order), VERIFY):
        kth = min(bound, best[k - 1][0] if len(best) >= k else math.inf)
        part = order[i:i + VERIFY]
        if projected[part[0]] > limit * kth * kth:
            break
        exact = np.sqrt(((vectors[part] - vector) ** 2).sum(axis=1))
        new = [(float(d), v) for d, row in zip(exact, part) if d <= kth
               for v in ids[row] if v != query_id or d or (vectors[row] != vector).any()]
        best = sorted(best + new)[:k]
    return best


def search(embeddings: DataFrame, every: int = 100, k: int = 10, dimensions: int = DIMENSIONS,
           confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found to each vector whose id is
    divisible by ``every``, nearest first."""
    result = "query_id long, rank int, vec_id long, score double"
    vectors = stored(usable(embeddings), "vectors")
    classes = stored(_classes(vectors, k + 1), "classes")
    n = classes.count()
    if not n:
        return embeddings.sparkSession.createDataFrame([], result)
    cells, limit = _fit(classes, n, dimensions), chi_square_quantile(confidence, dimensions)
    blocks = max(1, -(-n // (2 * CELL * cells.n_cells)))
    index = stored(_placed(classes, cells, "ids").withColumn(
        "block", F.pmod(F.xxhash64("vector"), F.lit(blocks))), "index")
    asked = vectors.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    queries = stored(_placed(asked, cells, "query_id").withColumn(
        "query", F.monotonically_increasing_id()), "queries")
    shape = "query long, query_id long, vec_id long, score double"

    def met(key: tuple, block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if block.num_rows and asked.num_rows:
            points, own = _matrix(block["point"], block.num_rows), block["ids"].to_pylist()
            whole = _matrix(block["vector"], block.num_rows)
            for r, q, p, v, b in zip(*(asked[c].to_pylist()
                                       for c in ("query", "query_id", "point", "vector", "bound"))):
                out += [(r, q, i, d) for d, i in best_in_block(
                    points, whole, own, q, np.array(p), np.array(v), k, b, limit)]
        r, q, i, d = zip(*out) if out else ((), (), (), ())
        return pa.table({"query": pa.array(r, pa.int64()), "query_id": pa.array(q, pa.int64()),
                         "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    visiting = ["query", "query_id", "point", "vector", "bound"]

    def searched(visits: DataFrame) -> DataFrame:
        """Visits are the columns ``visiting`` and ``cell``; a cell is copied once per
        ``QUERY_BLOCK`` visits to it, and not at all if nobody visits it."""
        def numbers(n: Column) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

        copies = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
        left = index.join(copies, "cell").select(*index.columns, numbers(F.col("parts")).alias("part"))
        right = visits.join(copies, "cell").select(
            *visiting, "cell", numbers(F.lit(blocks).cast("long")).alias("block"),
            F.pmod(F.xxhash64("query"), F.col("parts")).alias("part"))
        key = ["cell", "block", "part"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, shape)

    def other_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to = [], []
            for i, (p, b, home) in enumerate(zip(*(batch[c].to_pylist()
                                                   for c in ("point", "bound", "cell")))):
                visited = [c for c in cells.within(np.array(p), limit * b * b) if c != home]
                rows += [i] * len(visited)
                to += visited
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken[c] for c in visiting), pa.array(to, pa.int64())],
                                             names=[*visiting, "cell"])

    at_home = stored(searched(queries.withColumn("bound", F.lit(float("inf")))), "at_home")
    near = Window.partitionBy("query").orderBy("score", "vec_id")
    kth = (at_home.withColumn("rank", F.row_number().over(near)).where(F.col("rank") == k)
           .select("query", F.col("score").alias("bound")))
    bounded = stored(queries.join(kth, "query", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf")))), "bounded")
    visits = bounded.select(*visiting, "cell").mapInArrow(
        other_cells, "query long, query_id long, point array<double>, vector array<double>, "
                     "bound double, cell long")
    return (at_home.union(searched(visits)).withColumn("rank", F.row_number().over(near))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
