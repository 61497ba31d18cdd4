"""Imputation, outlier replacement and type repair.

Cleaning is fitted, then applied.  Fitting reads the sessions three times,
whatever the number of columns: means and modes, quartiles of the imputed
values, means of the inliers.  What it learns is a handful of numbers per
column, so applying it is a projection that fuses with whatever comes next.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from usagelens.functions.long import to_long
from usagelens.functions.orderstats import RankPolicy, quantiles
from usagelens.schema import DEFAULT, SessionSchema

UNKNOWN = "Unknown"
FENCE_REACH = 1.5
#: Columns of a stored model.
LEARNED = "kind string, variable string, text string, value double, low double, high double"
_LONG_MIN, _LONG_MAX = -(2 ** 63), 2 ** 63 - 1


# -- what is learned ---------------------------------------------------------

def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return row.asDict()


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, the smallest one on a tie.

    Values are counted in a shuffle keyed by (column, value); the winner is then
    an algebraic ``min_by``, so no task holds the whole value domain.
    """
    if not columns:
        return {}
    cells = df.select(*columns).unpivot([], list(columns), "variable", "value") \
              .where(F.col("value").isNotNull())
    counted = cells.groupBy("variable", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("variable").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()
    modes = {r.variable: r["mode"] for r in best}
    return {c: modes.get(c) for c in columns}


@dataclass(frozen=True)
class Fence:
    """Accepted range of a column and the value that replaces what lies outside."""

    low: float
    high: float
    inlier_mean: float | None = None

    def inside(self, c: Column) -> Column:
        return c.between(F.lit(self.low), F.lit(self.high))


@dataclass(frozen=True)
class CleaningModel:
    """Everything needed to clean further rows of the same table."""

    schema: SessionSchema
    means: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    fences: dict[str, Fence] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        """What was learned, as rows of the columns ``LEARNED``."""
        return [*[("mean", c, None, v, None, None) for c, v in self.means.items()],
                *[("mode", c, v, None, None, None) for c, v in self.modes.items()],
                *[("fence", c, None, f.inlier_mean, f.low, f.high) for c, f in self.fences.items()]]

    @classmethod
    def from_rows(cls, rows: Iterable[tuple], schema: SessionSchema = DEFAULT) -> CleaningModel:
        model = cls(schema)
        for kind, name, text, value, low, high in rows:
            if kind == "fence":
                model.fences[name] = Fence(low, high, value)
            else:
                (model.modes if kind == "mode" else model.means)[name] = text if kind == "mode" else value
        return model

    def imputed(self, name: str, dtype: T.DataType) -> Column:
        c = F.col(name)
        if name in self.modes:
            return F.coalesce(c, F.lit(self.modes[name]), F.lit(UNKNOWN))
        if self.means.get(name) is not None:
            filled = F.coalesce(c.cast("double"), F.lit(self.means[name]))
            return filled.cast(dtype) if name in self.schema.ids else filled
        return c

    def repaired(self, name: str, dtype: T.DataType) -> Column:
        filled, fence = self.imputed(name, dtype), self.fences.get(name)
        if fence is None or fence.inlier_mean is None:
            return filled
        # a null cell (column without any value) is no outlier and stays null
        return F.when(~fence.inside(filled), F.lit(fence.inlier_mean)).otherwise(filled)

    def transform(self, df: DataFrame) -> DataFrame:
        cleaned = df.select(*[self.repaired(f.name, f.dataType).alias(f.name)
                              for f in df.schema.fields])
        return add_total(cleaned, self.schema)


def fit_fences(df: DataFrame, values: dict[str, Column], mode: str = "exact",
               policy: RankPolicy = RankPolicy()) -> dict[str, Fence]:
    """Inter-quartile fences of several expressions, with the mean of the inliers."""
    if not values:
        return {}
    quartiles = quantiles(to_long(df, values), (0.25, 0.75), mode, policy=policy)
    bare = {}
    for name, (q1, q3) in quartiles.items():
        reach = FENCE_REACH * (q3 - q1)
        bare[name] = Fence(q1 - reach, q3 + reach)
    if not bare:
        return {}
    means = df.agg(*[F.avg(F.when(f.inside(values[name]), values[name])).alias(name)
                     for name, f in bare.items()]).first().asDict()
    return {name: Fence(f.low, f.high, means[name]) for name, f in bare.items()}


def fit_cleaning(df: DataFrame, schema: SessionSchema = DEFAULT, id_policy: str = "drop",
                 quantile_mode: str = "exact",
                 policy: RankPolicy = RankPolicy()) -> CleaningModel:
    """Learn how to clean ``df``.

    ``id_policy="drop"`` leaves missing identifiers null (grouping drops those
    sessions); ``"mean"`` fills them like any other number, which merges all
    anonymous sessions into one artificial user.
    """
    if id_policy not in ("drop", "mean"):
        raise ValueError(f"unknown id policy {id_policy!r}")
    measures = schema.numeric(df, skip_ids=True)
    imputable = schema.numeric(df) if id_policy == "mean" else measures
    model = CleaningModel(schema, column_means(df, imputable),
                          column_modes(df, schema.categorical(df)))
    types = {f.name: f.dataType for f in df.schema.fields}
    fences = fit_fences(df, {c: model.imputed(c, types[c]).cast("double") for c in measures},
                        quantile_mode, policy)
    return CleaningModel(schema, model.means, model.modes, fences)


# -- single steps ------------------------------------------------------------

def strip_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def impute(df: DataFrame, schema: SessionSchema = DEFAULT, id_policy: str = "mean") -> DataFrame:
    """Mean for numbers, mode for text, nothing else."""
    numbers = schema.numeric(df, skip_ids=id_policy == "drop")
    model = CleaningModel(schema, column_means(df, numbers),
                          column_modes(df, schema.categorical(df)))
    return df.select(*[model.imputed(f.name, f.dataType).alias(f.name)
                       for f in df.schema.fields])


def replace_outliers(df: DataFrame, schema: SessionSchema = DEFAULT,
                     quantile_mode: str = "exact",
                     policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Replace values beyond the fences by the mean of the inliers."""
    measures = schema.numeric(df, skip_ids=True)
    fences = fit_fences(df, {c: F.col(c).cast("double") for c in measures},
                        quantile_mode, policy)
    model = CleaningModel(schema, fences=fences)
    return df.select(*[model.repaired(f.name, f.dataType).alias(f.name)
                       for f in df.schema.fields])


def add_total(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Total volume, if both directions exist."""
    if schema.total_downlink in df.columns and schema.total_uplink in df.columns:
        return df.withColumn(schema.total,
                             F.col(schema.total_downlink) + F.col(schema.total_uplink))
    return df


def safe_integers(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Whole numbers as 64-bit integers, or as text where 64 bits are too few.

    Only decimals can overflow; their extremes come from a single aggregate.
    """
    whole = schema.integral(df)
    wide = [c for c in whole if isinstance(df.schema[c].dataType, T.DecimalType)
            and df.schema[c].dataType.precision > 18]
    overflow: set[str] = set()
    if wide:
        row = df.agg(*[F.min(c).alias(f"{c} low") for c in wide],
                     *[F.max(c).alias(f"{c} high") for c in wide]).first()
        overflow = {c for c in wide if row[f"{c} low"] is not None
                    and (row[f"{c} low"] < _LONG_MIN or row[f"{c} high"] > _LONG_MAX)}
    return df.select(*[
        F.col(c).cast("string" if c in overflow else "long").alias(c) if c in whole
        else F.col(c) for c in df.columns])


def typed_sessions(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """What a model is fitted on and applied to: plain names, integer types."""
    return safe_integers(strip_names(df), schema)


def clean(df: DataFrame, schema: SessionSchema = DEFAULT, id_policy: str = "drop",
          quantile_mode: str = "exact", policy: RankPolicy = RankPolicy()) -> DataFrame:
    """The whole cleaning: names, integer types, imputation, outliers, total."""
    typed = typed_sessions(df, schema)
    return fit_cleaning(typed, schema, id_policy, quantile_mode, policy).transform(typed)
