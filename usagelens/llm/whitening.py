"""Embedding whitening on the leading components of the covariance, found by FEAST.

Components are counted in whole units (``quantised``).  The fit uses every distinct vector once:
their number and sums are exact; the covariance is summed from vectors centred on the rounded
mean, one d x d matrix per task, and the centre's exact remainder is taken off.  Only d x d
numbers reach the driver, where ``feast`` extracts the leading eigenpairs; the dimension of the
embedding does not grow with the table.  Every row is then centred exactly and projected.

No part take null vectors, vectors with a null or non-finite component, vectors with a component
beyond 2^31 units, and vectors of another than the commonest length (the smaller on a tie).
Repeated rows are fitted once and each returned.  Null ids stay null.  Components whose eigenvalue is zero to
rounding are left out, as nothing there can be whitened: a table of one distinct vector, like an
empty one, has an empty result.  A deviation that does not fit into a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm import feast
from usagelens.llm.common import stored
from usagelens.llm.vectors import Batches, commonest_size, matrix, quantised

COMPONENTS = 16
LIMIT, SHIFT = 1 << 31, 1_000_000


def _summed_products(rows: DataFrame, wide) -> dict[tuple[int, int], float]:
    """Sum over all rows of the products of each two columns of ``wide(x)``; column -1 is one."""
    def products(batches: Batches) -> Batches:
        total, alone = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                y = wide(matrix(batch.column(0)))
                total, alone = total + y.T @ y, alone + y.sum(axis=0)
        if np.ndim(total):
            i, j = np.triu_indices(len(total))
            n = np.arange(len(alone))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i, n]).astype("i4")),
                 pa.array(np.concatenate([j, np.full(len(n), -1)]).astype("i4")),
                 pa.array(np.concatenate([total[i, j], alone]))], names=["i", "j", "value"])

    sums = rows.select("x").mapInArrow(products, "i int, j int, value double") \
        .groupBy("i", "j").agg(F.sum("value").alias("value"))
    return {(r.i, r.j): r.value for r in sums.collect()}


def _covariance(sums: dict[tuple[int, int], float], n: int, rest: np.ndarray) -> np.ndarray:
    """From product sums of columns whose means are ``rest``."""
    d = len(rest)
    products = np.array([[sums[min(i, j), max(i, j)] for j in range(d)] for i in range(d)])
    return products / n - np.outer(rest, rest)


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``total``; the columns of ``directions`` whiten."""

    n: int
    total: tuple[int, ...]
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times x less the sums, exact."""
        return self.n * x.astype("i8") - np.array(self.total, "i8")

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ (self.directions / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = self.centred(x)
        if float(np.abs(off).max()) ** 2 * x.shape[1] < 2.0 ** 62:
            return (off * off).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def apply(self, rows: DataFrame, identity_error: float) -> DataFrame:
        """A row per vector of ``vec_id, x`` and component."""
        shares, k = self.eigenvalues / self.trace, len(self.eigenvalues)

        def projected(batches: Batches) -> Batches:
            for batch in batches:
                if batch.num_rows:
                    x, size = matrix(batch.column(1)), batch.num_rows
                    each = pa.array(np.repeat(np.arange(size), k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), size)),
                         pa.array(np.full(size * k, self.n, "i8")),
                         pa.array(self.deviations(x), pa.int64()).take(each),
                         pa.array(self.whitened(x).ravel()), pa.array(np.tile(shares, size)),
                         pa.array(np.full(size * k, identity_error))],
                        names=[c.split()[0] for c in RESULT.split(", ")])

        return rows.select("vec_id", "x").mapInArrow(projected, RESULT)


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the rows of ``x``, each counted once as it is; none for an empty table."""
    first = distinct.first()
    if first is None:
        return None
    d = len(first.x)
    row = distinct.agg(F.count("*"), *[F.sum(F.get("x", F.lit(i))) for i in range(d)]).first()
    n, total = row[0], tuple(row[1:])
    centre = np.array([round(Fraction(s, n)) for s in total], "i8")
    rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(total, centre)])
    sums = _summed_products(distinct, lambda x: (x - centre).astype("f8"))
    covariance = _covariance(sums, n, rest)
    values, vectors = feast.leading(covariance, components)
    return Whitening(n, total, values, vectors, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance less the identity, measured over the rows."""
    k = len(model.eigenvalues)
    sums = _summed_products(distinct, model.whitened)
    means = np.array([sums[i, -1] for i in range(k)]) / model.n
    return float(np.abs(_covariance(sums, model.n, means) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every vector on the leading components, whitened; see ``RESULT``."""
    size = commonest_size(embeddings)
    if size:
        rows = stored(quantised(embeddings, size, LIMIT, SHIFT), "units")
        distinct = stored(rows.select("x").distinct(), "distinct")
        model = fit(distinct, components)
        if model and len(model.eigenvalues):
            return model.apply(rows, identity_error(distinct, model))
    return embeddings.sparkSession.createDataFrame([], RESULT)
