"""Centroid clustering: Lloyd rounds over column blocks, in whole numbers.

Rows are dealt into chunks, and a chunk is cut into blocks of columns.  A task holds one block
of a chunk and needs only that slice of the centroids: it returns the exact partial squared
distances.  Adding the blocks of a chunk gives whole distances and the nearest centroid
(ties: the smaller number).  The labels, one byte or two a row, go back to the blocks, which stay
where they are; every block sums its own columns by cluster, which gives its slice of the next
centroids.  Only k times the vector's length numbers a round reach the driver.

Start: the k vectors whose ids have the smallest SHA-256 of ``1:<vec_id>``, in that order;
equal ids by their components, vectors without id last.  Fewer vectors than k give as many
centroids.  A cluster nobody chose keeps its centroid.

No part take null vectors, vectors of another length, vectors with a null or non-finite
component, and vectors with a component beyond 2^27 units (two million), whose squared distance
would not fit into a long.  Repeated rows and repeated ids stay rows of their own.  Null ids stay null.  An
empty table has an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import stored
from usagelens.llm.vectors import Batches, matrix, quantised

#: Vector length, centroids, rounds; columns of a block.
SIZE, K, ROUNDS, BLOCK = 64, 16, 3, 16
LIMIT = 1 << 27
NUMBERS = "data binary, kind string"


def _packed(numbers: np.ndarray) -> tuple[bytes, str]:
    """Bytes of the narrowest integer type that holds the numbers, and its name."""
    kind = np.promote_types(np.min_scalar_type(int(numbers.min())),
                            np.min_scalar_type(int(numbers.max())))
    return numbers.astype(kind).tobytes(), kind.str


def _unpacked(data: bytes, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width).astype("i8")


def blocks_of(vectors: DataFrame, width: int = BLOCK) -> DataFrame:
    """``chunk, block, ids, data, kind`` of ``vec_id, x``: a chunk is one batch of rows; its ids
    are with block 0."""
    def cut(batches: Batches) -> Batches:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                parts = [_packed(x[:, i:i + width]) for i in range(0, x.shape[1], width)]
                ids = [batch.column(0).to_pylist(), *[None] * (len(parts) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(parts), pa.int64()),
                     pa.array(range(len(parts)), pa.int32()), pa.array(ids, pa.list_(pa.int64())),
                     *map(pa.array, zip(*parts))], names=["chunk", "block", "ids", "data", "kind"])
                chunk += 1

    return vectors.mapInArrow(cut, f"chunk long, block int, ids array<long>, {NUMBERS}")


def partial_distances(blocks: DataFrame, centroids: np.ndarray, width: int = BLOCK) -> DataFrame:
    """``chunk, data, kind``: squared distances within a block, a row per vector of the chunk."""
    slices = [centroids[:, i:i + width] for i in range(0, centroids.shape[1], width)]

    def measured(batches: Batches) -> Batches:
        for batch in batches:
            for chunk, block, data, kind in zip(*(c.to_pylist() for c in batch.columns)):
                own = slices[block]
                x = _unpacked(data, kind, own.shape[1])
                far = np.stack([((x - c) ** 2).sum(axis=1) for c in own], axis=1)
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("chunk", "data", "kind"), (chunk, *_packed(far))))])

    return blocks.select("chunk", "block", "data", "kind").mapInArrow(
        measured, f"chunk long, {NUMBERS}")


def nearest(blocks: DataFrame, centroids: np.ndarray, width: int = BLOCK) -> DataFrame:
    """``chunk, labels, distances`` from the sum of a chunk's partial distances."""
    k = len(centroids)

    def added(key: tuple, parts: pa.Table) -> pa.Table:
        whole = sum(_unpacked(d, t, k) for d, t in zip(parts["data"].to_pylist(),
                                                       parts["kind"].to_pylist()))
        labels = whole.argmin(axis=1)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()),
                         "labels": [labels.astype("u2").tobytes()],
                         "distances": [whole.min(axis=1).tobytes()]})

    return partial_distances(blocks, centroids, width).groupBy("chunk").applyInArrow(
        added, "chunk long, labels binary, distances binary")


def labelled(blocks: DataFrame, labels: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks with their rows' labels, which every block of a chunk gets."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    to = labels.select("chunk", every.alias("block"), "labels")
    return blocks.join(to, ["chunk", "block"])


def moved(blocks: DataFrame, labels: DataFrame, centroids: np.ndarray, width: int = BLOCK
          ) -> np.ndarray:
    """The next centroids: every block sums its own columns by cluster."""
    k, size = centroids.shape
    n_blocks = -(-size // width)

    def summed(batches: Batches) -> Batches:
        totals, counts = np.zeros((k, size), "i8"), np.zeros(k, "i8")
        for batch in batches:
            for block, data, kind, label in zip(*(c.to_pylist() for c in batch.columns)):
                at = block * width
                x = _unpacked(data, kind, min(width, size - at))
                own = np.frombuffer(label, "u2")
                for c in np.unique(own):
                    totals[c, at:at + width] += x[own == c].sum(axis=0)
                if block == 0:
                    counts += np.bincount(own, minlength=k)
        c, i = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([c, np.arange(k)]).astype("i4")),
             pa.array(np.concatenate([i, np.full(k, -1)]).astype("i4")),
             pa.array(np.concatenate([totals[c, i], counts]))],
            names=["cluster", "position", "total"])

    sums = (labelled(blocks, labels, n_blocks).select("block", "data", "kind", "labels")
            .mapInArrow(summed, "cluster int, position int, total long")
            .groupBy("cluster", "position").agg(F.sum("total").alias("total")))
    totals, counts = np.zeros((k, size), "i8"), np.zeros(k, "i8")
    for r in sums.collect():  # k times the vector's length
        if r.position < 0:
            counts[r.cluster] = r.total
        else:
            totals[r.cluster, r.position] = r.total
    return np.where(counts[:, None] > 0, totals // np.maximum(counts, 1)[:, None], centroids)


@dataclass(frozen=True)
class Clusters:
    """``rows`` are ``vec_id, cluster, distance``; ``centroids`` a row per cluster."""

    rows: DataFrame
    centroids: np.ndarray

    def described(self) -> DataFrame:
        """The rows with the inertia of their cluster and of all, and their centroid's digest."""
        sums = {r.cluster: r.inertia for r in self.rows.groupBy("cluster").agg(
            F.sum("distance").alias("inertia")).collect()}
        texts = [",".join(map(str, c)).encode() for c in self.centroids.tolist()]
        per_cluster = [(i, inertia, sum(sums.values()), hashlib.sha256(texts[i]).hexdigest())
                       for i, inertia in sorted(sums.items())]
        table = self.rows.sparkSession.createDataFrame(
            per_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return self.rows.join(F.broadcast(table), "cluster").select(  # k rows
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE,
            width: int = BLOCK, seed: int = 1) -> Clusters:
    """Assign every vector to one of ``k`` centroids after ``rounds`` rounds."""
    if not 0 < k <= 1 << 16:
        raise ValueError("k has to be between 1 and 65536")
    spark = embeddings.sparkSession
    vectors = quantised(embeddings, size, LIMIT)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"),
                        np.empty((0, size), "i8"))
    centroids = np.array([r.x for r in first], "i8")
    cut = stored(blocks_of(vectors, width), "blocks")
    # dealt by chunk and block once: labels move to the blocks, blocks do not move again
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut.drop("ids").repartition(tasks, "chunk", "block").persist(StorageLevel.DISK_ONLY)
    try:
        for _ in range(rounds):
            centroids = moved(held, nearest(held, centroids, width), centroids, width)
    finally:
        held.unpersist()

    def listed(batches: Batches) -> Batches:
        for batch in batches:
            for ids, labels, distances in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.frombuffer(labels, "u2").astype("i4")),
                     pa.array(np.frombuffer(distances, "i8"))],
                    names=["vec_id", "cluster", "distance"])

    last = nearest(cut, centroids, width).join(cut.where("block = 0").select("chunk", "ids"), "chunk")
    rows = last.select("ids", "labels", "distances").mapInArrow(
        listed, "vec_id long, cluster int, distance long")
    return Clusters(stored(rows, "clusters"), centroids)
