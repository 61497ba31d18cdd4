"""Satisfaction scores: distance of a user to the weakest segment.

A score is the Euclidean distance, in standard-scaled feature space, to the
centroid of one reference cluster: the one with the least traffic for
engagement, the one with the most retransmission for experience.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from usagelens.operators.clustering import Segmentation, cluster_means, fit_scaling, label_clusters
from usagelens.schema import DEFAULT, ENGAGEMENT_METRICS, EXPERIENCE_METRICS, SessionSchema

SCORES = ("engagement_score", "experience_score", "satisfaction_score")
SCORE_FEATURES = SCORES[:2]

# Labels per number of clusters, low to high, and the text shown for each.
SATISFACTION_LABELS = {
    2: ("Low Satisfaction Users", "High Satisfaction Users"),
    3: ("Low Satisfaction Users", "Moderate Users", "High Satisfaction Users"),
}
SATISFACTION_INSIGHTS = (
    ("Low Satisfaction Users",
     "Low engagement AND poor network experience. Immediate intervention required: "
     "investigate coverage gaps, reduce TCP retransmission rates, and proactively reach out "
     "with service-improvement offers to prevent churn."),
    ("Moderate Users",
     "Average engagement with acceptable experience. Growth potential exists — targeted "
     "up-sell campaigns and personalised data plan recommendations can elevate this segment "
     "toward high satisfaction."),
    ("High Satisfaction Users",
     "High engagement AND superior network experience. These are VIP customers: high data "
     "consumers with low latency and minimal packet loss. Protect with loyalty programmes, "
     "early access to new services, and dedicated support channels."),
)
DEFAULT_INSIGHT = "Mixed engagement and experience profile — monitor closely."


def distance_score(df: DataFrame, cluster: str, metrics: Sequence[str], reference: str,
                   highest: bool, column: str) -> DataFrame:
    """Add the distance to the centroid of the cluster with the extreme mean ``reference``.

    Two aggregates of ``df`` yield d numbers each; the score itself is a projection.
    """
    if cluster not in df.columns:
        raise ValueError(f"no column {cluster!r}: cluster the users first")
    present = [m for m in metrics if m in df.columns]
    # the mean that picks the cluster skips missing values, as aggregates do
    guide = reference if reference in present else present[0]
    means = cluster_means(df, cluster, present)
    key = -F.col(guide) if highest else F.col(guide)
    centroid = means.where(F.col(guide).isNotNull()).orderBy(key, F.col(cluster)).first()
    if centroid is None:
        raise ValueError("cannot score an empty table")
    scale = fit_scaling(df, present, "standard")
    total = F.lit(0.0)
    for i, m in enumerate(present):
        at = ((centroid[m] or 0.0) - scale.shift[i]) / scale.width[i]
        total = total + F.pow(scale.column(i) - F.lit(at), F.lit(2.0))
    return df.withColumn(column, F.sqrt(total))


def engagement_score(df: DataFrame, cluster: str = "engagement_cluster") -> DataFrame:
    return distance_score(df, cluster, ENGAGEMENT_METRICS, "total_traffic_bytes", False,
                          "engagement_score")


def experience_score(df: DataFrame, cluster: str = "experience_cluster") -> DataFrame:
    return distance_score(df, cluster, EXPERIENCE_METRICS, "avg_tcp_retransmission", True,
                          "experience_score")


def satisfaction_table(engagement: DataFrame, experience: DataFrame,
                       schema: SessionSchema = DEFAULT) -> DataFrame:
    """Both scores of every user present on both sides, and their mean."""
    left = engagement.select(schema.user, "engagement_score")
    right = experience.select(schema.user, "experience_score")
    return with_satisfaction(left.join(right, schema.user), schema)


def with_satisfaction(scored: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """User and scores of a table that holds both scores already."""
    return scored.select(schema.user, *SCORE_FEATURES).withColumn(
        "satisfaction_score", (F.col("engagement_score") + F.col("experience_score")) / 2)


def top_satisfied(table: DataFrame, schema: SessionSchema = DEFAULT, n: int = 10) -> DataFrame:
    return (table.select(schema.user, *SCORES)
            .orderBy(F.desc("satisfaction_score"), F.asc(schema.user)).limit(n))


def satisfaction_cluster_means(clustered: DataFrame,
                               cluster: str = "satisfaction_cluster") -> DataFrame:
    return cluster_means(clustered, cluster, SCORES)


def describe_satisfaction(clustered: DataFrame, segmentation: Segmentation,
                          cluster: str = "satisfaction_cluster") -> DataFrame:
    """Cluster means with a business label and the insight text for it."""
    means = satisfaction_cluster_means(clustered, cluster)
    k = len(segmentation.centroids)
    names = SATISFACTION_LABELS.get(
        k, tuple(f"Tier-{i} Users (Low → High)" for i in range(1, k + 1)))
    labels = label_clusters(means, cluster, F.col("satisfaction_score"), names)
    insights = F.broadcast(clustered.sparkSession.createDataFrame(  # three rows
        list(SATISFACTION_INSIGHTS), "label string, insight string"))
    return (means.join(F.broadcast(labels.select(cluster, "label")), cluster, "left")
            .join(insights, "label", "left")
            .withColumn("insight", F.coalesce("insight", F.lit(DEFAULT_INSIGHT)))
            .select(cluster, *SCORES, "label", "insight"))


def score_export(table: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """The exported shape: ``customer_id`` and the three scores."""
    return table.select(F.col(schema.user).alias("customer_id"), *SCORES)
