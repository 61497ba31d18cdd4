"""Vectors in whole units: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Units of one.
SCALE = 64
Batches = Iterator[pa.RecordBatch]


def commonest_size(embeddings: DataFrame, column: str = "embedding") -> int | None:
    """The length most vectors have, the smaller one on a tie; null vectors do not count."""
    sizes = embeddings.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("size"))
    first = sizes.count().orderBy(F.desc("count"), "size").first()
    return first and first["size"]


def lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(matrix) + 1, dtype="i4") * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length, none of them null, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quantised(embeddings: DataFrame, size: int, limit: int, shift: int = 0,
              key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, x``: every component c as ``floor(64 c) + shift``.

    Left out are null vectors, vectors of another length, and vectors with a component that is
    null, not finite, or beyond ``limit`` units.
    """
    def converted(batches: Batches) -> Batches:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), size), False)
            rows = batch.filter(fits)
            if not rows.num_rows:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                units = np.floor(SCALE * matrix(rows.column(1)).astype("f8"))
                good = (np.abs(units) <= limit).all(axis=1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).filter(pa.array(good)), lists(units[good].astype("i8") + shift)],
                names=["vec_id", "x"])

    return embeddings.select(F.col(key).cast("long"), F.col(column).cast("array<double>")) \
        .mapInArrow(converted, "vec_id long, x array<long>")
