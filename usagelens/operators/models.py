"""Regression of the satisfaction score: training, validation, scoring.

Boosted trees are grown on histograms (``operators.boosting``), the hold-out model and those
of all cross-validation folds in the same passes.  The random forest comes from ``pyspark.ml``.
Ridge is solved in closed form from one aggregate of means and covariances, so training reads
the table once and all folds share a single pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.functions.cuts import border_rows, bucket
from usagelens.operators.boosting import Boosted, Training, boost
from usagelens.operators.scoring import SCORE_FEATURES
from usagelens.schema import DEFAULT, SessionSchema
from usagelens.workspace import allow_rdd_checkpoints

TARGET = "satisfaction_score"
PREDICTION = "predicted_satisfaction"
SEED = 42
FOLDS, TEST_PCT = 5, 20

# Hyper-parameters of the candidate models.
CANDIDATES: dict[str, dict[str, Any]] = {
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "random_forest": {"n_estimators": 100, "max_depth": 5},
    "ridge": {"alpha": 1.0},
}


#: Candidate split points per feature of the random forest.
MAX_BINS = 512


# -- splits ------------------------------------------------------------------

def split_bucket(key: str | Column, seed: int = SEED) -> Column:
    """0-99 from a hash of the key: the same row lands in the same bucket anywhere."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def train_test_split(df: DataFrame, key: str, test_pct: int = TEST_PCT,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Deterministic hold-out split by key; neither side shuffles."""
    is_test = split_bucket(key, seed) < test_pct
    return df.where(~is_test), df.where(is_test)


def with_fold(df: DataFrame, key: str, folds: int = FOLDS,
              mode: str = "contiguous") -> DataFrame:
    """Add ``fold`` 0..folds-1: contiguous in key order, or by hash.

    Contiguous folds have sizes differing by one at most, the larger first.  Only
    the border keys are looked up; no row is ranked.
    """
    if mode == "hash":
        return df.withColumn("fold", (split_bucket(key) % folds).cast("int"))
    if mode != "contiguous":
        raise ValueError(f"unknown fold mode {mode!r}")
    own = F.col(key)

    def last_ranks(n: int) -> list[int]:
        if n < folds:
            raise ValueError(f"{n} rows cannot fill {folds} folds")
        small, larger = divmod(n, folds)
        return [i * small + min(i, larger) for i in range(1, folds)]

    borders = border_rows(df, own, own, last_ranks)
    if not borders:
        raise ValueError("no rows to fold")
    return df.withColumn("fold", bucket(own, own, borders, first=0))


# -- ridge -------------------------------------------------------------------

@dataclass(frozen=True)
class RidgeModel:
    """Linear model with an unpenalised intercept."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def prediction(self) -> Column:
        total = F.lit(self.intercept)
        for f, b in zip(self.features, self.coefficients):
            total = total + F.lit(b) * F.col(f)
        return total

    def transform(self, df: DataFrame, column: str = PREDICTION) -> DataFrame:
        return df.withColumn(column, self.prediction())

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, f, b) for i, (f, b) in enumerate(zip(self.features, self.coefficients))]
        spark.createDataFrame(rows + [(len(rows), "", self.intercept)],
                              "position int, feature string, weight double") \
             .coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RidgeModel":
        rows = spark.read.parquet(path).orderBy("position").collect()
        return cls(tuple(r.feature for r in rows[:-1]), tuple(r.weight for r in rows[:-1]),
                   rows[-1].weight)

    def as_table(self, df: DataFrame) -> DataFrame:
        rows = [*zip(self.features, self.coefficients), ("intercept", self.intercept)]
        return df.sparkSession.createDataFrame(rows, "term string, weight double")


def _moments(features: Sequence[str], target: str, among: Column | None = None) -> list[Column]:
    """Row count, means and covariances (times n-1 later) of features and target."""
    names = [*features, target]

    def only(c: str) -> Column:
        return F.col(c) if among is None else F.when(among, F.col(c))

    pairs = [(a, b) for i, a in enumerate(features) for b in [*features[i:], target]]
    return [F.count(only(target)).alias("n"),
            *[F.avg(only(c)).alias(f"avg {c}") for c in names],
            *[F.covar_samp(only(a), only(b)).alias(f"cov {a} {b}") for a, b in pairs]]


def _solve(row: Mapping[str, Any], features: Sequence[str], target: str,
           alpha: float) -> RidgeModel:
    d = len(features)
    gram, moment = np.zeros((d, d)), np.zeros(d)
    scale = row["n"] - 1
    for i, a in enumerate(features):
        moment[i] = row[f"cov {a} {target}"] * scale
        for j in range(i, d):
            gram[i, j] = gram[j, i] = row[f"cov {a} {features[j]}"] * scale
    beta = np.linalg.solve(gram + alpha * np.eye(d), moment)
    mean = np.array([row[f"avg {f}"] for f in features])
    return RidgeModel(tuple(features), tuple(float(b) for b in beta),
                      float(row[f"avg {target}"] - beta @ mean))


def fit_ridge(df: DataFrame, features: Sequence[str] = SCORE_FEATURES, target: str = TARGET,
              alpha: float = 1.0) -> RidgeModel:
    """Ridge by its normal equations; only d x d sums leave the executors."""
    return _solve(df.agg(*_moments(features, target)).first().asDict(), features, target, alpha)


def ridge_cv(df: DataFrame, key: str, features: Sequence[str] = SCORE_FEATURES,
             target: str = TARGET, alpha: float = 1.0, folds: int = FOLDS,
             mode: str = "contiguous") -> DataFrame:
    """RMSE of ridge on each fold: one pass fits all folds, one scores them."""
    table = with_fold(df, key, folds, mode)
    numbered = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    fits = (table.withColumn("left_out", numbered).where(F.col("left_out") != F.col("fold"))
            .groupBy("left_out").agg(*_moments(features, target)).collect())
    models = {r.left_out: _solve(r.asDict(), features, target, alpha) for r in fits}
    guess = None
    for i, m in models.items():
        guess = (F.when(F.col("fold") == i, m.prediction()) if guess is None
                 else guess.when(F.col("fold") == i, m.prediction()))
    return (table.withColumn("error", F.col(target) - guess).groupBy("fold")
            .agg(F.count("*").alias("rows"),
                 F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")))


# -- trees -------------------------------------------------------------------

def _forest(features: Sequence[str], target: str, params: Mapping[str, Any], seed: int) -> Pipeline:
    forest = RandomForestRegressor(
        numTrees=params["n_estimators"], maxDepth=params["max_depth"], maxBins=MAX_BINS,
        featureSubsetStrategy="all", seed=seed, featuresCol="features", labelCol=target,
        predictionCol=PREDICTION)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest])


def fit_boosted(df: DataFrame, key: str, members: Sequence[Column], features: Sequence[str],
                target: str, params: Mapping[str, Any]) -> Training:
    """A boosted model per entry of ``members``, all of them in the same passes."""
    more = {k: params[k] for k in ("bins",) if k in params}
    return boost(df.select(*{key: None, **dict.fromkeys(features), target: None},
                           *[m.alias(f"member {i}") for i, m in enumerate(members)]),
                 features, target, key, [F.col(f"member {i}") for i in range(len(members))],
                 params["n_estimators"], params["learning_rate"], params["max_depth"], **more)


Model = RidgeModel | Boosted | PipelineModel


def fit_model(df: DataFrame, name: str, features: Sequence[str] = SCORE_FEATURES,
              target: str = TARGET, params: Mapping[str, Any] | None = None,
              seed: int = SEED) -> Model:
    """Fit one of the candidates by name."""
    if name not in CANDIDATES:
        raise ValueError(f"unknown model {name!r}")
    settings = {**CANDIDATES[name], **(params or {})}
    if name == "ridge":
        return fit_ridge(df, features, target, settings["alpha"])
    if name == "gradient_boosting":
        return fit_boosted(df, features[0], [F.lit(True)], features, target, settings).models[0]
    allow_rdd_checkpoints(df.sparkSession)
    return _forest(features, target, settings, seed).fit(df.select(*features, target))


def score(df: DataFrame, model: Model) -> DataFrame:
    """Add ``predicted_satisfaction`` to every row."""
    kept = [c for c in df.columns if c != PREDICTION]
    if isinstance(model, Boosted):
        return model.transform(df.select(*kept), PREDICTION)
    return model.transform(df.select(*kept)).select(*kept, PREDICTION)


def save_model(df: DataFrame, model: Model, path: str) -> None:
    if isinstance(model, (RidgeModel, Boosted)):
        model.save(df.sparkSession, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a stored model; a missing one is a ``FileNotFoundError``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        raise FileNotFoundError(f"no model at {path}; train one first")
    stages = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stages")
    if fs.exists(stages):
        return PipelineModel.load(path)
    boosted = "threshold" in spark.read.parquet(path).columns
    return Boosted.load(spark, path) if boosted else RidgeModel.load(spark, path)


def score_or_average(df: DataFrame, path: str) -> DataFrame:
    """Score with the stored model, or average the two scores if there is none."""
    try:
        return score(df, load_model(df.sparkSession, path))
    except FileNotFoundError:
        a, b = SCORE_FEATURES
        return df.withColumn(PREDICTION, (F.col(a) + F.col(b)) / 2)


# -- evaluation --------------------------------------------------------------

def regression_metrics(scored: DataFrame, target: str = TARGET,
                       prediction: str = PREDICTION) -> DataFrame:
    """mse, rmse, mae and r2 in one aggregate."""
    error = F.col(target) - F.col(prediction)
    spread = F.var_pop(target)
    mse = F.avg(error * error)
    return scored.agg(F.count("*").alias("rows"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                      F.avg(F.abs(error)).alias("mae"),
                      (1 - mse / F.nullif(spread, F.lit(0.0))).alias("r2"))


def forest_cv(df: DataFrame, key: str, name: str, features: Sequence[str] = SCORE_FEATURES,
              target: str = TARGET, params: Mapping[str, Any] | None = None,
              folds: int = FOLDS, mode: str = "contiguous",
              parallelism: int = FOLDS) -> DataFrame:
    """RMSE of a tree model on each fold; folds are fitted side by side."""
    table = with_fold(df.select(key, *features, target), key, folds, mode)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def one(fold: int) -> tuple[int, int, float]:
            model = fit_model(table.where(F.col("fold") != fold), name, features, target, params)
            row = regression_metrics(score(table.where(F.col("fold") == fold), model),
                                     target).first()
            return fold, row["rows"], row["rmse"]

        with ThreadPoolExecutor(parallelism) as pool:
            rows = list(pool.map(one, range(folds)))
    finally:
        table.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, rows long, rmse double")


def boosted_cv(df: DataFrame, key: str, features: Sequence[str] = SCORE_FEATURES,
               target: str = TARGET, params: Mapping[str, Any] | None = None, folds: int = FOLDS,
               mode: str = "contiguous") -> DataFrame:
    """RMSE of boosted trees on each fold; the folds' models are grown in the same passes."""
    table = with_fold(df, key, folds, mode)
    settings = {**CANDIDATES["gradient_boosting"], **(params or {})}
    found = fit_boosted(table, key, [F.col("fold") != i for i in range(folds)], features, target,
                        settings)
    return df.sparkSession.createDataFrame(
        list(zip(range(folds), found.unseen_rows, found.unseen_rmse)),
        "fold int, rows long, rmse double")


def cross_validate(df: DataFrame, key: str, name: str, **kwargs) -> DataFrame:
    if name == "gradient_boosting":
        return boosted_cv(df, key, **kwargs)
    if name == "ridge":
        kwargs.pop("params", None)
        return ridge_cv(df, key, **kwargs)
    return forest_cv(df, key, name, **kwargs)


def boosted_hold_out(df: DataFrame, key: str, features: Sequence[str], target: str,
                     params: Mapping[str, Any], with_cv: bool) -> tuple[Boosted, float | None]:
    """The hold-out model and, from the same training, the mean RMSE over contiguous folds."""
    members = [~(split_bucket(key) < TEST_PCT)]
    if with_cv:
        df = with_fold(df, key)
        members += [F.col("fold") != i for i in range(FOLDS)]
    found = fit_boosted(df, key, members, features, target, params)
    return found.models[0], sum(found.unseen_rmse[1:]) / FOLDS if with_cv else None


# -- tracking ----------------------------------------------------------------

RUN_SCHEMA = ("model_name string, run_id string, start_time timestamp, end_time timestamp, "
              "source string, train_rows long, test_rows long, mse double, rmse double, "
              "mae double, r2 double, cv_rmse double, train_duration_sec double, "
              "params map<string,string>")


def train(df: DataFrame, name: str = "gradient_boosting", key: str | None = None,
          features: Sequence[str] = SCORE_FEATURES, target: str = TARGET,
          params: Mapping[str, Any] | None = None, schema: SessionSchema = DEFAULT,
          with_cv: bool = True) -> tuple[Model, DataFrame]:
    """Hold-out training of one model; returns it with a one-row run record."""
    key = key or schema.user
    training, test = train_test_split(df, key)
    started, cv = datetime.now(timezone.utc), None
    if name == "gradient_boosting":
        model, cv = boosted_hold_out(df, key, features, target,
                                     {**CANDIDATES[name], **(params or {})}, with_cv)
    else:
        model = fit_model(training, name, features, target, params)
    metrics = regression_metrics(score(test, model), target).first()
    ended = datetime.now(timezone.utc)
    if with_cv and cv is None:
        cv = cross_validate(df, key, name, features=features, target=target,
                            params=params).agg(F.avg("rmse")).first()[0]
    settings = {**CANDIDATES[name], **(params or {}), "features": list(features), "seed": SEED}
    record = (name, uuid.uuid4().hex, started, ended, "hold-out 80/20", training.count(),
              metrics["rows"], metrics.mse, metrics.rmse, metrics.mae, metrics.r2, cv,
              (ended - started).total_seconds(), {k: str(v) for k, v in settings.items()})
    return model, df.sparkSession.createDataFrame([record], RUN_SCHEMA)


def append_run(record: DataFrame, path: str) -> None:
    """Add a run record to the runs table."""
    record.coalesce(1).write.mode("append").parquet(path)


def train_all(df: DataFrame, names: Sequence[str] = tuple(CANDIDATES), **kwargs) -> DataFrame:
    """Train every candidate and order the run records by rmse."""
    records = [train(df, name, **kwargs)[1] for name in names]
    table = records[0]
    for r in records[1:]:
        table = table.unionByName(r)
    return table.orderBy("rmse")
