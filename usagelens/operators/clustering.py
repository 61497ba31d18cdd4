"""K-means segments and the tables derived from them.

Three ways to fit.  ``lloyd`` runs Lloyd rounds from rank-chosen rows until no centroid
moves: fully reproducible, so it can be checked against SQL.  ``restarted`` also runs them
from drawn starts and keeps the cheapest fit, which is never dearer than the rank-chosen one.
Both use ``operators.kmeans``: all k and all starts share every round.  ``kmeans`` fits one k
with ``pyspark.ml``, several restarts over one cached vector column.  Where starts are drawn,
cluster ids are made stable by ordering them on a named metric.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.functions.cuts import border_rows
from usagelens.functions.long import to_long
from usagelens.functions.orderstats import RankPolicy
from usagelens.operators.kmeans import Points, drawn_start, settle
from usagelens.operators.statistics import box_statistics, grid_counts
from usagelens.schema import require

#: Iterations after which a fit by ``pyspark.ml`` ends; restarts of a seeded fit.
MAX_ITERATIONS, RESTARTS = 300, 10
#: Rows of a task and fits at a time of ``pyspark.ml``.
ROWS_PER_TASK, FITS_AT_ONCE = 100_000, 16
#: A centroid that moves by less (in scaled units) stands still: rounding of sums.
STILL = 1e-12

#: Ways to fit: drawn restarts, one rank-chosen start, ``pyspark.ml``.
METHODS = ("restarts", "lloyd", "ml")

ENGAGEMENT_LABELS = ("Low", "Medium", "High")
EXPERIENCE_LABELS = ("Good", "Average", "Poor")


# -- scaling -----------------------------------------------------------------

@dataclass(frozen=True)
class Scaling:
    """Per-feature shift and width; a constant feature scales to zero."""

    features: tuple[str, ...]
    shift: tuple[float, ...]
    width: tuple[float, ...]

    def column(self, i: int) -> Column:
        return (_filled(self.features[i]) - F.lit(self.shift[i])) / F.lit(self.width[i])

    def columns(self) -> list[Column]:
        return [self.column(i) for i in range(len(self.features))]


def _filled(feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("double"), F.lit(0.0))


def fit_scaling(df: DataFrame, features: Sequence[str], kind: str) -> Scaling:
    """``"minmax"`` or ``"standard"`` (population deviation), one aggregate."""
    if kind == "minmax":
        parts = [(F.min(_filled(c)), F.max(_filled(c)) - F.min(_filled(c))) for c in features]
    elif kind == "standard":
        parts = [(F.avg(_filled(c)), F.stddev_pop(_filled(c))) for c in features]
    else:
        raise ValueError(f"unknown scaling {kind!r}")
    row = df.agg(*[p.alias(f"{i} {j}") for i, pair in enumerate(parts)
                   for j, p in enumerate(pair)]).first()
    if row["0 0"] is None:
        raise ValueError("cannot scale an empty table")
    d = range(len(features))
    return Scaling(tuple(features), tuple(row[f"{i} 0"] for i in d),
                   tuple(row[f"{i} 1"] or 1.0 for i in d))


# -- reproducible Lloyd iterations -------------------------------------------

Centroids = tuple[tuple[float, ...], ...]


def _squared_distance(point: Sequence[Column], centroid: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for x, c in zip(point, centroid):
        total = total + (x - F.lit(c)) * (x - F.lit(c))
    return total


def _nearest(point: Sequence[Column], centroids: Centroids) -> Column:
    """Struct ``(distance, cluster)`` of the nearest centroid, lowest id on a tie."""
    return F.array_min(F.array(*[
        F.struct(_squared_distance(point, c).alias("distance"), F.lit(i).alias("cluster"))
        for i, c in enumerate(centroids)]))


def seed_rows(df: DataFrame, key: str, scaling: Scaling,
              ks: Sequence[int]) -> dict[int, Centroids]:
    """Start centroids: for each k the rows at ranks ``ceil(n (2i+1) / 2k)``
    when ordered by the first feature, then key."""
    first, tie = _filled(scaling.features[0]), F.col(key)
    spots = [(k, i) for k in ks for i in range(k)]
    borders = border_rows(df, first, tie,
                          lambda n: [-(-n * (2 * i + 1) // (2 * k)) for k, i in spots])
    kind = df.schema[key].dataType.simpleString()
    chosen = F.broadcast(df.sparkSession.createDataFrame(  # sum of ks rows
        sorted({(b.value, b.tie) for b in borders}), f"first double, tie {kind}"))
    points = df.select(first.alias("first"), tie.alias("tie"),
                       F.array(*scaling.columns()).alias("point"))
    at = {(r["first"], r.tie): tuple(r.point)
          for r in points.join(chosen, ["first", "tie"]).collect()}
    rows = iter(borders)
    return {k: tuple(at[(b.value, b.tie)] for b in (next(rows) for _ in range(k))) for k in ks}


@dataclass(frozen=True)
class Segmentation:
    """Fitted centroids (in scaled space), ready to assign rows."""

    scaling: Scaling
    centroids: Centroids

    def assign(self, df: DataFrame, column: str) -> DataFrame:
        nearest = _nearest(self.scaling.columns(), self.centroids)
        return df.withColumn(column, nearest["cluster"])


def lloyd_many(df: DataFrame, key: str, features: Sequence[str], ks: Sequence[int],
               scaling: str = "minmax",
               max_iterations: int | None = None) -> dict[int, Segmentation]:
    """Fit several k side by side from rank-chosen rows."""
    require(df, [key, *features], "k-means")
    scale = fit_scaling(df, features, scaling)
    points = Points(df, scale.columns())
    try:
        found = settle(points, _rank_starts(df, key, scale, ks), STILL, max_iterations)
    finally:
        points.release()
    return {k: _segmentation(scale, found[k]) for k in ks}


def _rank_starts(df: DataFrame, key: str, scale: Scaling, ks: Sequence[int]) -> dict[int, np.ndarray]:
    return {k: np.array(c) for k, c in seed_rows(df, key, scale, ks).items()}


def _segmentation(scale: Scaling, centroids: np.ndarray) -> Segmentation:
    return Segmentation(scale, tuple(tuple(float(x) for x in c) for c in centroids))


def lloyd(df: DataFrame, key: str, features: Sequence[str], k: int,
          scaling: str = "minmax") -> Segmentation:
    return lloyd_many(df, key, features, [k], scaling)[k]


def inertia(df: DataFrame, fits: dict[int, Segmentation]) -> dict[int, float]:
    """Sum of squared scaled distances to the nearest centroid, one pass for all fits."""
    row = df.agg(*[F.sum(_nearest(s.scaling.columns(), s.centroids)["distance"]).alias(str(k))
                   for k, s in fits.items()]).first()
    return {k: row[str(k)] for k in fits}


# -- restarts ----------------------------------------------------------------

@dataclass(frozen=True)
class Restarted:
    """The cheapest fit of one k and the cost of each start: 0 is the rank-chosen one."""

    segmentation: Segmentation
    costs: tuple[float, ...]

    @property
    def cost(self) -> float:
        return min(self.costs)


def restarted_many(df: DataFrame, key: str, features: Sequence[str], ks: Sequence[int],
                   scaling: str = "minmax", restarts: int = RESTARTS, seed: int = 42,
                   order_by: str | None = None,
                   max_iterations: int | None = None) -> dict[int, Restarted]:
    """For each k the cheapest of ``restarts`` fits, one from rank-chosen rows, the others from
    drawn ones; of equally cheap fits the first.  Ids ascend with the centroid's ``order_by``."""
    require(df, [key, *features], "k-means")
    scale = fit_scaling(df, features, scaling)
    points = Points(df, scale.columns())
    try:
        starts = {(k, 0): c for k, c in _rank_starts(df, key, scale, ks).items()}
        sample = points.sample()
        if len(sample):
            starts |= {(k, r): drawn_start(sample, k, (seed, k, r))
                       for k in ks for r in range(1, restarts)}
        found = settle(points, starts, STILL, max_iterations)
        costs = points.costs(found)
    finally:
        points.release()
    lead, out = list(features).index(order_by or features[0]), {}
    for k in ks:
        own = [f for f in found if f[0] == k]
        best = found[min(own, key=lambda f: (costs[f], f))]
        centroids = sorted(best.tolist(), key=lambda c: (c[lead], c))
        out[k] = Restarted(_segmentation(scale, np.array(centroids)),
                           tuple(costs[f] for f in sorted(own)))
    return out


def restarted(df: DataFrame, key: str, features: Sequence[str], k: int, scaling: str = "minmax",
              restarts: int = RESTARTS, seed: int = 42, order_by: str | None = None) -> Restarted:
    return restarted_many(df, key, features, [k], scaling, restarts, seed, order_by)[k]


# -- pyspark.ml --------------------------------------------------------------

def _held_vectors(df: DataFrame, scale: Scaling) -> tuple[DataFrame, DataFrame]:
    """Numbers held in memory, and their vectors, which are not.

    A fit takes two jobs an iteration and most of a small table's time is starting tasks, so tasks
    get ``ROWS_PER_TASK`` rows.  A fit over held vectors would decode them in every iteration; over
    others it reads the numbers once and keeps vectors and norms of its own until it ends.
    """
    tasks = max(1, -(-df.count() // ROWS_PER_TASK))
    names = [f"x{i}" for i in range(len(scale.features))]
    held = df.coalesce(tasks).select(*[c.alias(n) for n, c in zip(names, scale.columns())]) \
             .persist(StorageLevel.MEMORY_AND_DISK)
    held.count()  # else the first fits all read the table
    return held, VectorAssembler(inputCols=names, outputCol="features").transform(held).select("features")


def _cheapest(vectors: DataFrame, ks: Sequence[int], restarts: int, seed: int) -> dict[int, KMeansModel]:
    """Per k the cheapest of several seeded fits; the fits of all k run side by side."""
    def one(start: tuple[int, int]) -> KMeansModel:
        k, i = start
        return KMeans(k=k, seed=seed + i, featuresCol="features", maxIter=MAX_ITERATIONS,
                      tol=1e-6).fit(vectors)

    starts = [(k, i) for k in sorted(ks, reverse=True) for i in range(restarts)]  # longest first
    best: dict[int, KMeansModel] = {}
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        for (k, _), m in zip(starts, pool.map(one, starts)):
            if k not in best or m.summary.trainingCost < best[k].summary.trainingCost:
                best[k] = m
    return best


def kmeans(df: DataFrame, features: Sequence[str], k: int, scaling: str = "minmax",
           restarts: int = RESTARTS, seed: int = 42, order_by: str | None = None) -> Segmentation:
    """Best of several k-means|| runs; ids ascend with the centroid's ``order_by``."""
    require(df, features, "k-means")
    scale = fit_scaling(df, features, scaling)
    held, vectors = _held_vectors(df, scale)
    try:
        centers = [tuple(float(x) for x in c)
                   for c in _cheapest(vectors, [k], restarts, seed)[k].clusterCenters()]
    finally:
        held.unpersist()
    lead = list(features).index(order_by or features[0])
    return Segmentation(scale, tuple(sorted(centers, key=lambda c: (c[lead], c))))


def elbow(df: DataFrame, key: str, features: Sequence[str], max_k: int = 10,
          scaling: str = "minmax", method: str = "restarts", restarts: int = RESTARTS,
          seed: int = 42) -> DataFrame:
    """Inertia for k = 1..max_k, its second difference and the suggested k.

    One cluster needs no fit: its inertia is the rows times the variance.
    """
    scale = fit_scaling(df, features, scaling)
    whole = df.agg(*[(F.var_pop(c) * F.count("*")).alias(str(i))
                     for i, c in enumerate(scale.columns())]).first()
    costs = {1: float(sum(whole))}
    ks = list(range(2, max_k + 1))
    if method == "lloyd" and ks:
        costs |= inertia(df, lloyd_many(df, key, features, ks, scaling))
    elif method == "restarts" and ks:
        found = restarted_many(df, key, features, ks, scaling, restarts, seed)
        costs |= {k: found[k].cost for k in ks}
    elif method == "ml":
        held, vectors = _held_vectors(df, scale)
        try:
            for k, model in _cheapest(vectors, ks, restarts, seed).items():
                costs[k] = float(model.summary.trainingCost)
        finally:
            held.unpersist()
    elif method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    curve = df.sparkSession.createDataFrame(sorted(costs.items()), "k int, inertia double")
    in_order = Window.partitionBy().orderBy("k")  # max_k rows
    # the bend sits in the middle of the three points of a second difference
    bend = (F.lead("inertia", 1).over(in_order) - 2 * F.col("inertia")
            + F.lag("inertia", 1).over(in_order))
    bent = curve.withColumn("second_difference", bend)
    best = F.max_by("k", F.when(F.col("second_difference").isNotNull(),
                                F.struct("second_difference", -F.col("k"))))
    return bent.withColumn("optimal_k", best.over(Window.partitionBy()))


# -- tables over a cluster column --------------------------------------------

def cluster_statistics(df: DataFrame, cluster: str, metrics: Sequence[str]) -> DataFrame:
    """Min, max, mean and sum of every metric per cluster."""
    present = [m for m in metrics if m in df.columns]
    return df.groupBy(cluster).agg(*[
        f(m).alias(f"{m}_{name}") for m in present
        for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sum", F.sum))])


def cluster_share(df: DataFrame, cluster: str, metrics: Sequence[str]) -> DataFrame:
    """Users and metric totals per cluster, each also in percent of the whole."""
    present = [m for m in metrics if m in df.columns]
    table = df.groupBy(cluster).agg(F.count("*").alias("user_count"),
                                    *[F.sum(m).alias(f"{m}_total") for m in present])
    everything = Window.partitionBy()  # k rows

    def percent(c: str) -> Column:
        whole = F.sum(c).over(everything).cast("double")
        return F.col(c) / F.nullif(whole, F.lit(0.0)) * 100

    return table.withColumns({"user_pct": percent("user_count"),
                              **{f"{m}_pct": percent(f"{m}_total") for m in present}})


def cluster_means(df: DataFrame, cluster: str, metrics: Sequence[str],
                  suffix: str = "") -> DataFrame:
    present = [m for m in metrics if m in df.columns]
    return df.groupBy(cluster).agg(*[F.avg(m).alias(m + suffix) for m in present])


def cluster_distribution(df: DataFrame, cluster: str, metrics: Sequence[str]) -> DataFrame:
    """Users, their share and the mean of each metric per cluster."""
    present = [m for m in metrics if m in df.columns]
    table = df.groupBy(cluster).agg(F.count("*").alias("user_count"),
                                    *[F.avg(m).alias(f"{m}_mean") for m in present])
    return table.withColumn("user_pct", F.col("user_count") * 100.0
                            / F.sum("user_count").over(Window.partitionBy()))


def label_clusters(means: DataFrame, cluster: str, score: Column,
                   labels: Sequence[str]) -> DataFrame:
    """Label clusters in ascending order of a score over their means.

    With another number of clusters than labels they become ``Tier-1``, ``Tier-2``...
    """
    everything = Window.partitionBy()  # k rows
    rank = F.row_number().over(everything.orderBy(score.asc(), F.col(cluster).asc()))
    named = F.when(F.count("*").over(everything) == len(labels),
                   F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("rank")))
    return (means.select(cluster, rank.alias("rank"))
            .withColumn("label", F.coalesce(
                named, F.concat(F.lit("Tier-"), F.col("rank").cast("string")))))


def engagement_labels(df: DataFrame, cluster: str, metrics: Sequence[str]) -> DataFrame:
    """Low / Medium / High by the mean of the raw metric means."""
    present = [m for m in metrics if m in df.columns]
    score = sum((F.col(m) for m in present[1:]), F.col(present[0])) / len(present)
    return label_clusters(cluster_means(df, cluster, present), cluster, score,
                          ENGAGEMENT_LABELS)


def experience_labels(df: DataFrame, cluster: str,
                      metric: str = "avg_tcp_retransmission") -> DataFrame:
    """Good / Average / Poor by ascending mean retransmission."""
    return label_clusters(cluster_means(df, cluster, [metric]), cluster, F.col(metric),
                          EXPERIENCE_LABELS)


def cluster_grid(df: DataFrame, cluster: str, pairs: Sequence[tuple[str, str]],
                 bins: int = 50) -> DataFrame:
    """Bin counts per cluster for each pair of metrics (the scatter plots' data)."""
    points = F.array(*[F.struct(F.lit(f"{x} vs {y}").alias("variable"),
                                F.col(x).cast("double").alias("x"),
                                F.col(y).cast("double").alias("y"))
                       for x, y in pairs if x in df.columns and y in df.columns])
    return (grid_counts(df.select(cluster, F.inline(points)), bins, keep=[cluster])
            .withColumnRenamed("variable", "pair"))


def cluster_boxes(df: DataFrame, cluster: str, metrics: Sequence[str],
                  policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Box statistics of every metric within every cluster."""
    long = to_long(df, [m for m in metrics if m in df.columns], keep=[cluster])
    keyed = long.withColumn("box", F.concat_ws("|", F.col(cluster).cast("string"), "variable"))
    boxes = box_statistics(keyed.select("box", "value"), "box", policy=policy)
    parts = F.split("box", r"\|", 2)
    return boxes.select(parts[0].cast("int").alias(cluster), parts[1].alias("metric"),
                        *[c for c in boxes.columns if c != "box"])


def labelled(df: DataFrame, labels: DataFrame, cluster: str, column: str) -> DataFrame:
    """Rows with ``"<id> - <label>"`` of their cluster."""
    names = labels.select(cluster, "label")
    text = F.concat(F.col(cluster).cast("string"), F.lit(" - "),
                    F.coalesce("label", F.col(cluster).cast("string")))
    return df.join(names, cluster, "left").withColumn(column, text).drop("label")
