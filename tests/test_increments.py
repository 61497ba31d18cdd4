"""Features from batches, and distinct counts from daily sketches."""

import pytest
from pyspark.sql import functions as F

from usagelens.operators import features, reports, sketches
from usagelens.operators.increments import IncrementalFeatures
from usagelens.schema import DEFAULT, ENGAGEMENT_METRICS


def values(df, columns):
    def plain(v):
        return round(v, 4) if isinstance(v, float) else v
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def test_batches_equal_a_full_build(spark, cleaned, tmp_path):
    kept = IncrementalFeatures(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError):
        kept.features(cleaned)
    parts = [cleaned.where(F.pmod(F.xxhash64("bearer_id", "start_ts"), F.lit(3)) == i) for i in range(3)]
    assert [kept.add(str(i), p) for i, p in enumerate(parts)] == [True] * 3
    assert kept.add("none", cleaned.limit(0)) and not kept.add("1", parts[1])
    found = kept.features(cleaned)
    whole = features.user_features(cleaned)
    shared = [c for c in whole.columns if c in found.columns]
    assert len(shared) > 15 and set(ENGAGEMENT_METRICS) <= set(shared)
    assert values(found, shared) == values(whole, shared)
    modal = found.select(DEFAULT.user, F.col("modal_handset").alias(DEFAULT.handset))
    assert values(modal, modal.columns) == values(features.user_modal_handset(cleaned), modal.columns)
    last = features.user_last_handset(cleaned)
    mine = found.select(DEFAULT.user, *[F.col(f"last_{c}").alias(c) for c in last.columns[1:]])
    assert values(mine, last.columns) == values(last, last.columns)
    overview = features.user_overview(cleaned)
    sums = [c for c in overview.columns if c in found.columns]
    assert values(found, sums) == values(overview, sums)


def test_a_failed_batch_can_be_added_again(spark, cleaned, tmp_path):
    kept = IncrementalFeatures(spark, str(tmp_path / "state"))
    kept.add("first", cleaned.limit(100))
    broken = cleaned.withColumn(DEFAULT.duration, F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        kept.add("second", broken)
    assert kept.add("second", cleaned.limit(0)) and not kept.add("first", cleaned)
    total = kept.features(cleaned).agg(F.sum("sessions_frequency")).first()[0]
    assert total == cleaned.limit(100).where(f"{DEFAULT.user} IS NOT NULL").count()


def test_daily_sketches_unite_to_the_exact_counts(cleaned):
    days = sketches.daily_figures(cleaned)
    found, exact = sketches.banner(days).first(), reports.kpi_banner(cleaned).first()
    for c in ("total_records", "unique_users", "handset_types"):  # small counts are exact
        assert found[c] == exact[c]
    assert abs(found.total_dl_tb - exact.total_dl_tb) < 1e-12
    halves = [days.where(F.pmod(F.dayofyear("day"), F.lit(2)) == i) for i in (0, 1)]
    both = sketches.united(halves[0]).unionByName(sketches.united(halves[1]))
    assert sketches.banner(both).first().unique_users == exact.unique_users


def test_estimates_keep_their_error(spark):
    many = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") % 40 * 86_400).alias("start_ts"),
        (F.col("id") % 50_000).alias("user_id"), (F.col("id") % 30_000).cast("string").alias("handset_type"),
        F.lit(1.0).alias("total_dl"), F.lit(1.0).alias("total_ul"))
    days = sketches.daily_figures(many)
    found = sketches.banner(days).first()
    assert days.count() == 40 and found.total_records == 60_000
    assert abs(found.unique_users / 50_000 - 1) < 4 * sketches.ERROR
    assert abs(found.handset_types / 30_000 - 1) < 4 * sketches.ERROR
