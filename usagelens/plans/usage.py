"""The analysis from sessions to satisfaction as a graph of tables.

Each node is built once, on first use, from the nodes it needs.  Cleaning stays
a projection; the user feature table (one pass, one shuffle) and the
satisfaction table are written to the shared scratch folder because clustering
and scoring read them repeatedly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from usagelens.functions.orderstats import RankPolicy
from usagelens.operators import clustering, features, scoring
from usagelens.operators.cleaning import CleaningModel, fit_cleaning, safe_integers
from usagelens.schema import DEFAULT, ENGAGEMENT_METRICS, EXPERIENCE_METRICS, SessionSchema
from usagelens.workspace import materialise


class UsagePlan:
    """Lazy nodes of the analysis over one session table, raw or already ``cleaned``.

    ``parts`` limits the work to the features of interest: only their columns are
    scanned, cleaned and aggregated.  ``method`` is ``"restarts"`` (the
    cheapest of several starts), ``"lloyd"`` (one rank-chosen start) or ``"ml"`` (``pyspark.ml``).
    """

    def __init__(self, sessions: DataFrame, schema: SessionSchema = DEFAULT,
                 parts: Sequence[str] = features.PARTS, method: str = "restarts", cleaned: bool = False,
                 id_policy: str = "drop", quantile_mode: str = "exact",
                 restarts: int = clustering.RESTARTS, k_engagement: int = 3,
                 k_experience: int = 3, k_satisfaction: int = 2,
                 policy: RankPolicy = RankPolicy()) -> None:
        if method not in clustering.METHODS:
            raise ValueError(f"unknown clustering method {method!r}")
        self.schema, self.parts, self.method = schema, tuple(parts), method
        self.id_policy, self.quantile_mode = id_policy, quantile_mode
        self.restarts, self.policy = restarts, policy
        self.k_engagement, self.k_experience = k_engagement, k_experience
        self.k_satisfaction = k_satisfaction
        self.already_clean = cleaned
        self.sessions = sessions.select(*features.part_inputs(sessions, schema, self.parts))

    @cached_property
    def _typed(self) -> DataFrame:
        return safe_integers(self.sessions, self.schema)

    @cached_property
    def cleaning(self) -> CleaningModel:
        return fit_cleaning(self._typed, self.schema, self.id_policy, self.quantile_mode,
                            self.policy)

    @cached_property
    def cleaned(self) -> DataFrame:
        return self.sessions if self.already_clean else self.cleaning.transform(self._typed)

    @cached_property
    def overview(self) -> DataFrame:
        """Sessions, volumes and last handset per user, of whatever columns ``parts`` keeps."""
        return materialise(features.user_overview(self.cleaned, self.schema), "user_overview")

    @cached_property
    def users(self) -> DataFrame:
        table = features.user_features(self.cleaned, self.schema, self.parts)
        return materialise(table, "user_features")

    @property
    def engagement(self) -> DataFrame:
        return self.users.select(self.schema.user, "sessions_frequency", "total_duration_ms",
                                 "total_dl_bytes", "total_ul_bytes", "total_traffic_bytes")

    @property
    def traffic(self) -> DataFrame:
        return self.users.select(self.schema.user, *[
            a.total for a in self.schema.applications if a.total in self.users.columns])

    @property
    def experience(self) -> DataFrame:
        names = [n for m in self.schema.quality for n in (m.downlink_mean, m.uplink_mean)]
        wanted = [self.schema.user, *names, *EXPERIENCE_METRICS, self.schema.handset]
        return self.users.select(*[c for c in wanted if c in self.users.columns])

    def _fit(self, df: DataFrame, metrics: Sequence[str], k: int, scaling: str,
             order_by: str) -> clustering.Segmentation:
        present = [m for m in metrics if m in df.columns]
        if self.method == "lloyd":
            return clustering.lloyd(df, self.schema.user, present, k, scaling)
        if self.method == "restarts":
            return clustering.restarted(df, self.schema.user, present, k, scaling, self.restarts,
                                        order_by=order_by).segmentation
        return clustering.kmeans(df, present, k, scaling, self.restarts, order_by=order_by)

    @cached_property
    def _engagement_fit(self) -> clustering.Segmentation:
        return self._fit(self.engagement, ENGAGEMENT_METRICS, self.k_engagement, "minmax",
                         "total_traffic_bytes")

    @cached_property
    def _experience_fit(self) -> clustering.Segmentation:
        return self._fit(self.experience, EXPERIENCE_METRICS, self.k_experience, "standard",
                         "avg_tcp_retransmission")

    @cached_property
    def engagement_clustered(self) -> DataFrame:
        return self._engagement_fit.assign(self.engagement, "engagement_cluster")

    @cached_property
    def experience_clustered(self) -> DataFrame:
        return self._experience_fit.assign(self.experience, "experience_cluster")

    @cached_property
    def engagement_labels(self) -> DataFrame:
        return clustering.engagement_labels(self.engagement_clustered, "engagement_cluster",
                                            ENGAGEMENT_METRICS)

    @cached_property
    def experience_labels(self) -> DataFrame:
        return clustering.experience_labels(self.experience_clustered, "experience_cluster")

    @cached_property
    def satisfaction(self) -> DataFrame:
        """Both scores side by side: one projection of the user table, no join."""
        clustered = self._experience_fit.assign(
            self._engagement_fit.assign(self.users, "engagement_cluster"), "experience_cluster")
        scored = scoring.experience_score(scoring.engagement_score(clustered))
        return materialise(scoring.with_satisfaction(scored, self.schema), "satisfaction")

    @cached_property
    def satisfaction_segmentation(self) -> clustering.Segmentation:
        return self._fit(self.satisfaction, scoring.SCORE_FEATURES, self.k_satisfaction,
                         "standard", "engagement_score")

    @cached_property
    def satisfaction_clustered(self) -> DataFrame:
        return self.satisfaction_segmentation.assign(self.satisfaction, "satisfaction_cluster")
