"""Principal components of standardised application volumes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from usagelens.operators.clustering import Scaling, fit_scaling


@dataclass(frozen=True)
class Components:
    """Fitted components.  Signs are fixed so that each one's largest loading is positive."""

    scaling: Scaling
    model: PCAModel
    signs: tuple[float, ...]

    def explained(self, df: DataFrame) -> DataFrame:
        """Scree table: share of variance per component, in order."""
        rows = [(f"PC{i}", float(v), float(v) * 100)
                for i, v in enumerate(self.model.explainedVariance, 1)]
        return df.sparkSession.createDataFrame(
            rows, "component string, explained_ratio double, explained_pct double")

    def loadings(self, df: DataFrame) -> DataFrame:
        matrix = self.model.pc.toArray()
        rows = [(name, *(float(matrix[i, j]) * s for j, s in enumerate(self.signs)))
                for i, name in enumerate(self.scaling.features)]
        schema = "variable string, " + ", ".join(
            f"PC{j} double" for j in range(1, len(self.signs) + 1))
        return df.sparkSession.createDataFrame(rows, schema)

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Coordinates of every row in component space."""
        out = vector_to_array(self.model.getOutputCol())
        return self.model.transform(_assembled(df, self.scaling, keep)).select(
            *keep, *[(out[j] * s).alias(f"PC{j + 1}") for j, s in enumerate(self.signs)])


def _assembled(df: DataFrame, scale: Scaling, keep: Sequence[str]) -> DataFrame:
    names = [f"z{i}" for i in range(len(scale.features))]
    flat = df.select(*keep, *[c.alias(n) for n, c in zip(names, scale.columns())])
    return VectorAssembler(inputCols=names, outputCol="z").transform(flat).select(*keep, "z")


def fit_components(df: DataFrame, columns: Sequence[str], k: int = 2) -> Components:
    """Missing values count as zero; columns are standardised before the fit."""
    columns = list(dict.fromkeys(columns))
    scale = fit_scaling(df, columns, "standard")
    model = PCA(k=min(k, len(columns)), inputCol="z", outputCol="pc").fit(
        _assembled(df, scale, []))
    matrix = model.pc.toArray()
    signs = []
    for j in range(matrix.shape[1]):
        lead = max(range(matrix.shape[0]), key=lambda i: abs(matrix[i, j]))
        signs.append(-1.0 if matrix[lead, j] < 0 else 1.0)
    return Components(scale, model, tuple(signs))
