"""Presentation tables: KPIs, segment tables, key findings.

Inputs are user tables or cluster-level tables of k rows; joins between the
latter are broadcast because k is fixed by the segmentation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.long import to_long
from usagelens.functions.orderstats import RankPolicy
from usagelens.operators.clustering import (cluster_distribution, cluster_means, cluster_share,
                                            cluster_statistics)
from usagelens.operators.statistics import box_statistics, histogram
from usagelens.schema import (DEFAULT, ENGAGEMENT_METRICS, EXPERIENCE_METRICS, SessionSchema)

MS_PER_HOUR = 3_600_000
INFINITY = float("inf")


def kpi_banner(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Records, distinct users and handsets, volume per direction in TB.

    Sessions are first reduced to (user, handset) pairs, so the distinct counts
    work on the pairs instead of every session.
    """
    pairs = df.groupBy(schema.user, schema.handset).agg(
        F.count("*").alias("n"), F.sum(schema.total_downlink).alias("dl"),
        F.sum(schema.total_uplink).alias("ul"))
    return pairs.agg(F.sum("n").alias("total_records"),
                     F.countDistinct(schema.user).alias("unique_users"),
                     F.countDistinct(schema.handset).alias("handset_types"),
                     (F.sum("dl") / 1e12).alias("total_dl_tb"),
                     (F.sum("ul") / 1e12).alias("total_ul_tb"))


def experience_kpis(experience: DataFrame) -> DataFrame:
    return experience.agg(F.count("*").alias("users"),
                          *[F.avg(m).alias(m) for m in reversed(EXPERIENCE_METRICS)])


def experience_preview(experience: DataFrame, schema: SessionSchema = DEFAULT,
                       n: int = 20) -> DataFrame:
    """First users with their headline metrics."""
    shown = [c for c in (schema.user, *EXPERIENCE_METRICS, schema.handset)
             if c in experience.columns]
    return experience.select(*shown).orderBy(schema.user).limit(n)


def _segment_rows(statistics: DataFrame, shares: DataFrame, labels: DataFrame,
                  cluster: str) -> DataFrame:
    own = [c for c in shares.columns if c == cluster or c not in statistics.columns]
    return (statistics.join(F.broadcast(shares.select(*own)), cluster)
            .join(F.broadcast(labels.select(cluster, "rank", "label")), cluster))


def engagement_segments(users: DataFrame, labels: DataFrame,
                        cluster: str = "engagement_cluster") -> DataFrame:
    """One row per segment in label order, in display units."""
    rows = _segment_rows(cluster_statistics(users, cluster, ENGAGEMENT_METRICS),
                         cluster_share(users, cluster, ENGAGEMENT_METRICS), labels, cluster)
    c = F.col
    return rows.orderBy("rank").select(
        F.concat(F.lit("Cluster "), c(cluster).cast("string")).alias("cluster"),
        c("label").alias("classification"),
        c("user_count").alias("users"),
        F.round("user_pct", 1).alias("users_pct"),
        c("sessions_frequency_min").alias("sessions_min"),
        c("sessions_frequency_max").alias("sessions_max"),
        F.round("sessions_frequency_mean", 2).alias("sessions_avg"),
        c("sessions_frequency_sum").alias("sessions_total"),
        F.round(c("total_duration_ms_mean") / MS_PER_HOUR, 2).alias("duration_avg_hours"),
        F.round(c("total_traffic_bytes_mean") / 1e6, 2).alias("traffic_avg_mb"),
        F.round(c("total_traffic_bytes_sum") / 1e9, 2).alias("traffic_total_gb"),
        F.round("total_traffic_bytes_pct", 1).alias("traffic_pct"))


def _of(label: str, value: Column) -> Column:
    """The value of the one row carrying ``label``."""
    return F.max(F.when(F.col("label") == label, value))


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, infinite where the denominator is not positive."""
    return F.when(denominator > 0, numerator / F.when(denominator > 0, denominator)) \
            .otherwise(F.lit(INFINITY))


def engagement_key_finding(users: DataFrame, labels: DataFrame,
                           cluster: str = "engagement_cluster") -> DataFrame:
    """High against Low: share of users and traffic, session and traffic ratio."""
    rows = _segment_rows(cluster_statistics(users, cluster, ENGAGEMENT_METRICS),
                         cluster_share(users, cluster, ENGAGEMENT_METRICS), labels, cluster)
    sessions, traffic = F.col("sessions_frequency_mean"), F.col("total_traffic_bytes_mean")
    ends = rows.agg(_of("High", F.col("user_pct")).alias("high_user_pct"),
                    _of("High", F.col("total_traffic_bytes_pct")).alias("high_traffic_pct"),
                    _of("High", sessions).alias("hs"), _of("Low", sessions).alias("ls"),
                    _of("High", traffic).alias("ht"), _of("Low", traffic).alias("lt"))
    return ends.select("high_user_pct", "high_traffic_pct",
                       _ratio(F.col("hs"), F.col("ls")).alias("session_ratio"),
                       _ratio(F.col("ht"), F.col("lt")).alias("traffic_ratio"))


def means_long(users: DataFrame, labels: DataFrame, cluster: str,
               metrics: Sequence[str]) -> DataFrame:
    """Cluster means as ``(cluster name, metric, mean)`` rows in label order."""
    means = cluster_means(users, cluster, metrics)
    long = to_long(means, [m for m in metrics if m in means.columns], keep=[cluster],
                   variable="metric", value="mean_value")
    return (long.join(F.broadcast(labels.select(cluster, "rank", "label")), cluster)
            .orderBy("rank", "metric")
            .select(F.concat(F.col(cluster).cast("string"), F.lit(" - "), "label")
                     .alias("cluster"), "label", "metric", "mean_value"))


def experience_segments(users: DataFrame, labels: DataFrame,
                        cluster: str = "experience_cluster") -> DataFrame:
    rows = _segment_rows(cluster_statistics(users, cluster, EXPERIENCE_METRICS),
                         cluster_distribution(users, cluster, EXPERIENCE_METRICS),
                         labels, cluster)
    figures = [F.round(f"{metric}_{stat}", 1).alias(f"{short}_{name}")
               for metric, short in zip(EXPERIENCE_METRICS, ("tcp", "rtt", "throughput"))
               for stat, name in (("mean", "avg"), ("max", "max"))]
    return rows.orderBy("rank").select(
        F.concat(F.lit("Cluster "), F.col(cluster).cast("string")).alias("cluster"),
        F.col("label").alias("classification"), F.col("user_count").alias("users"),
        F.round("user_pct", 1).alias("users_pct"), *figures)


def experience_key_finding(users: DataFrame, labels: DataFrame,
                           cluster: str = "experience_cluster") -> DataFrame:
    """Poor against Good: user shares, retransmission and throughput gaps."""
    rows = _segment_rows(cluster_means(users, cluster, EXPERIENCE_METRICS),
                         cluster_distribution(users, cluster, EXPERIENCE_METRICS),
                         labels, cluster)
    tcp, speed = F.col("avg_tcp_retransmission"), F.col("avg_throughput_kbps")
    one = F.lit(1.0)
    return rows.agg(
        _of("Poor", F.col("user_pct")).alias("poor_user_pct"),
        _of("Good", F.col("user_pct")).alias("good_user_pct"),
        F.round(_of("Poor", tcp) / F.greatest(_of("Good", tcp), one)).alias("tcp_gap"),
        F.round(_of("Good", speed) / F.greatest(_of("Poor", speed), one), 1)
         .alias("throughput_gap"))


def score_distribution(table: DataFrame, metric: str = "satisfaction_score",
                       policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Five-number summary, whiskers, mean and outliers of one score."""
    return box_statistics(to_long(table, [metric], variable="metric"), "metric", policy=policy)


def score_density(table: DataFrame, metric: str = "satisfaction_score",
                  bins: int = 60) -> DataFrame:
    """Binned density of one score: shares per unit, integrating to one."""
    bars = histogram(table, [metric], bins)
    whole = bars.agg(F.sum("count").alias("rows"))
    return (bars.crossJoin(F.broadcast(whole))  # one row
            .withColumn("density", F.col("count") / F.nullif("rows", F.lit(0))
                        / (F.col("bin_end") - F.col("bin_start"))).drop("rows"))


def score_space_grid(table: DataFrame, per_decade: int = 10) -> DataFrame:
    """Users and mean satisfaction per cell of the score plane on log axes.

    Scores of zero have no place on a log axis and are left out.
    """
    x, y = F.col("engagement_score"), F.col("experience_score")
    return (table.where((x > 0) & (y > 0))
            .groupBy(F.floor(F.log10(x) * per_decade).cast("int").alias("engagement_bin"),
                     F.floor(F.log10(y) * per_decade).cast("int").alias("experience_bin"))
            .agg(F.count("*").alias("users"),
                 F.avg("satisfaction_score").alias("satisfaction_score")))


def default_inputs(table: DataFrame) -> DataFrame:
    """Mean scores, the preset of a what-if prediction."""
    return table.agg(F.avg("engagement_score").alias("engagement_score"),
                     F.avg("experience_score").alias("experience_score"))
