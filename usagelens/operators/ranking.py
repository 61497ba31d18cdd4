"""Top-N reports.

A single ranking is ``orderBy().limit()``: every task keeps N rows in a heap and
only those travel.  A ranking per metric or group is ``row_number() <= N`` over
a window; Catalyst pushes the limit below the shuffle, so each task ships at most
N rows per group even if one group is a third of the table.  Every order ends
with a key, so ties never depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions.long import to_long
from usagelens.schema import (DEFAULT, ENGAGEMENT_METRICS, EXPERIENCE_METRICS,
                              SessionSchema, require)


def top_values(df: DataFrame, column: str, n: int, count: str = "session_count") -> DataFrame:
    """The ``n`` most frequent non-null values of a column."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count("*").alias(count))
              .orderBy(F.desc(count), F.asc(column)).limit(n))


def top_handsets(df: DataFrame, schema: SessionSchema = DEFAULT, n: int = 10) -> DataFrame:
    return top_values(df, schema.handset, n)


def top_manufacturers(df: DataFrame, schema: SessionSchema = DEFAULT, n: int = 3) -> DataFrame:
    return top_values(df, schema.manufacturer, n)


def market_share(df: DataFrame, schema: SessionSchema = DEFAULT, n: int = 3) -> DataFrame:
    """Share of each top manufacturer among the top ones, in percent."""
    top = top_manufacturers(df, schema, n)
    among = F.sum("session_count").over(Window.partitionBy())  # n rows
    return top.withColumn("share_pct", F.col("session_count") / among * 100)


def top_handsets_per_manufacturer(df: DataFrame, schema: SessionSchema = DEFAULT,
                                  n_manufacturers: int = 3, n_handsets: int = 5) -> DataFrame:
    """Most frequent handset types within each of the top manufacturers.

    Sessions are counted once per (manufacturer, type); manufacturer totals are
    sums of those counts and share the same shuffle.
    """
    make, model = schema.manufacturer, schema.handset
    counted = (df.where(F.col(make).isNotNull()).groupBy(make, model)
                 .agg(F.count("*").alias("session_count")))
    leaders = (counted.groupBy(make).agg(F.sum("session_count").alias("n"))
               .orderBy(F.desc("n"), F.asc(make)).limit(n_manufacturers).select(make))
    best = Window.partitionBy(make).orderBy(F.desc("session_count"), F.asc(model))
    return (counted.where(F.col(model).isNotNull())
            .join(F.broadcast(leaders), make)  # at most n_manufacturers rows
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= n_handsets)
            .select(make, "rank", model, "session_count"))


def top_per_metric(df: DataFrame, key: str, metrics: Sequence[str], n: int = 10,
                   variable: str = "metric") -> DataFrame:
    """Top ``n`` keys for each metric, as one long table."""
    present = [m for m in metrics if m in df.columns]
    long = to_long(df, present, keep=[key], variable=variable)
    best = Window.partitionBy(variable).orderBy(F.desc("value"), F.asc(key))
    return (long.withColumn("rank", F.row_number().over(best))
                .where(F.col("rank") <= n).select(variable, "rank", key, "value"))


def top_engaged(engagement: DataFrame, schema: SessionSchema = DEFAULT,
                n: int = 10) -> DataFrame:
    return top_per_metric(engagement, schema.user, ENGAGEMENT_METRICS, n)


def top_per_application(traffic: DataFrame, schema: SessionSchema = DEFAULT,
                        n: int = 10) -> DataFrame:
    """Top ``n`` users per application by bytes."""
    suffix = "_total_bytes"
    table = top_per_metric(traffic, schema.user,
                           [a.total for a in schema.applications], n, "application")
    return table.withColumn("application", F.expr(
        f"substring(application, 1, length(application) - {len(suffix)})"))


def top_applications(traffic: DataFrame, schema: SessionSchema = DEFAULT,
                     n: int = 3) -> DataFrame:
    """Applications with the most traffic, in GB."""
    apps = [a for a in schema.applications if a.total in traffic.columns]
    totals = traffic.agg(*[F.sum(a.total).alias(a.key) for a in apps])
    return (totals.unpivot([], [a.key for a in apps], "application", "total_bytes")
            .withColumn("total_gb", F.col("total_bytes") / 1e9)
            .orderBy(F.desc("total_bytes"), F.asc("application")).limit(n))


def extremes(df: DataFrame, key: str, metrics: Sequence[str], n: int = 10) -> DataFrame:
    """Highest, lowest and most frequent values of each metric.

    Columns: ``metric, kind, rank, <key>, value, count``; ``count`` is filled for
    the most frequent values, the key for the other two kinds.
    """
    require(df, metrics, "extremes")
    long = to_long(df, metrics, keep=[key], variable="metric")

    def ranked(kind: str, rows: DataFrame, *order) -> DataFrame:
        w = Window.partitionBy("metric").orderBy(*order)
        return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                .select("metric", F.lit(kind).alias("kind"), "rank", key, "value", "count"))

    single = long.withColumn("count", F.lit(None).cast("long"))
    counted = (long.groupBy("metric", "value").agg(F.count("*").alias("count"))
               .withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
    return (ranked("top", single, F.desc("value"), F.asc(key))
            .unionByName(ranked("bottom", single, F.asc("value"), F.asc(key)))
            .unionByName(ranked("most_frequent", counted, F.desc("count"), F.asc("value"))))


def top_bottom_frequent(experience: DataFrame, metric: str,
                        schema: SessionSchema = DEFAULT, n: int = 10) -> DataFrame:
    """The three rankings for one metric; an unknown metric is a ``KeyError``."""
    return extremes(experience, schema.user, [metric], n).drop("metric")


def experience_extremes(experience: DataFrame, schema: SessionSchema = DEFAULT,
                        n: int = 10) -> DataFrame:
    present = [m for m in EXPERIENCE_METRICS if m in experience.columns]
    return extremes(experience, schema.user, present, n)


def mean_by_group(df: DataFrame, group: str, metric: str, n: int,
                  descending: bool = True) -> DataFrame:
    """Groups with the highest or lowest mean of a metric."""
    require(df, [group, metric], "mean by group")
    order = F.desc(metric) if descending else F.asc(metric)
    return (df.where(F.col(group).isNotNull()).groupBy(group)
              .agg(F.avg(metric).alias(metric))
              .orderBy(order, F.asc(group)).limit(n))


def throughput_per_handset(experience, schema=DEFAULT, n=10) -> DataFrame:
    return mean_by_group(experience, schema.handset, "avg_throughput_kbps", n)


def throughput_bottom_handsets(experience, schema=DEFAULT, n=10) -> DataFrame:
    return mean_by_group(experience, schema.handset, "avg_throughput_kbps", n, False)


def tcp_per_handset(experience, schema=DEFAULT, n=10) -> DataFrame:
    return mean_by_group(experience, schema.handset, "avg_tcp_retransmission", n)


def tcp_best_handsets(experience, schema=DEFAULT, n=10) -> DataFrame:
    return mean_by_group(experience, schema.handset, "avg_tcp_retransmission", n, False)


def _best_and_worst(experience: DataFrame, schema: SessionSchema, metric: str) -> DataFrame:
    """One row: handsets with the highest and lowest mean of ``metric``.

    Both ends come from the same small per-handset table by algebraic
    ``max_by``/``min_by``, so the users are read once.
    """
    group = schema.handset
    means = (experience.where(F.col(group).isNotNull()).groupBy(group)
             .agg(F.avg(metric).alias("mean")).where(F.col("mean").isNotNull()))
    return means.agg(
        F.min_by(group, F.struct(-F.col("mean"), F.col(group))).alias("highest_handset"),
        F.max("mean").alias("highest"),
        F.min_by(group, F.struct(F.col("mean"), F.col(group))).alias("lowest_handset"),
        F.min("mean").alias("lowest"))


def throughput_gap(experience: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """How many times faster the best handset is than the worst; infinite over zero."""
    ends = _best_and_worst(experience, schema, "avg_throughput_kbps")
    gap = F.when(F.col("lowest") > 0, F.round(F.col("highest") / F.nullif("lowest", F.lit(0.0)), 1))
    return ends.select(F.col("highest_handset").alias("best_handset"),
                       F.col("lowest_handset").alias("worst_handset"),
                       F.coalesce(gap, F.lit(float("inf"))).alias("gap"))


def tcp_gap(experience: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Retransmission of the worst handset over the best, the divisor at least one."""
    ends = _best_and_worst(experience, schema, "avg_tcp_retransmission")
    return ends.select(
        F.col("highest_handset").alias("worst_handset"),
        F.col("lowest_handset").alias("best_handset"),
        F.round(F.col("highest") / F.greatest(F.col("lowest"), F.lit(1.0))).alias("gap"))
