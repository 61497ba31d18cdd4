import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.operators import features
from usagelens.schema import APPLICATIONS, EXPERIENCE_METRICS


def test_contracts(users, cleaned):
    ov = features.user_overview(cleaned)
    assert {"user_id", "sessions_count", "total_duration_ms", "total_dl_bytes", "total_ul_bytes",
            "total_data_bytes", "handset_manufacturer", "handset_type"} <= set(ov.columns)
    assert sum(c.endswith("_sum") for c in ov.columns) == 14
    assert {a.total for a in APPLICATIONS} <= set(users.columns)
    assert set(EXPERIENCE_METRICS) <= set(users.columns)
    assert ov.where("sessions_count <= 0 OR total_dl_bytes < 0").isEmpty()


def test_every_known_user_is_kept_once(cleaned, users):
    known = cleaned.where("user_id IS NOT NULL").select("user_id").distinct().count()
    assert users.count() == known == users.select("user_id").distinct().count()


def test_sums_match_pandas(sessions, raw):
    got = features.user_engagement(sessions).toPandas().set_index("user_id").sort_index()
    by = raw.groupby("user_id")
    assert (got.sessions_frequency == by["dur_ms"].count().values).all()
    assert np.allclose(got.total_duration_ms, by["dur_ms"].sum())
    assert np.allclose(got.total_traffic_bytes, by["total_dl"].sum() + by["total_ul"].sum())


def test_quality_means_match_pandas(sessions, raw):
    got = features.user_experience(sessions).toPandas().set_index("user_id").sort_index()
    by = raw.groupby("user_id")
    want = (by["rtt_dl_ms"].mean() + by["rtt_ul_ms"].mean()) / 2
    assert np.allclose(got.avg_rtt_ms, want, equal_nan=True)


def test_missing_volume_counts_zero(spark):
    df = spark.createDataFrame([(1, 5.0, None), (1, None, 2.0), (2, None, None)],
                               "user_id long, google_dl double, google_ul double")
    got = {r.user_id: r.google_total_bytes for r in features.user_app_traffic(df).collect()}
    assert got == {1: 7.0, 2: 0.0}


def test_absent_direction_counts_zero_and_is_still_halved(spark):
    df = spark.createDataFrame([(1, 10.0, "x")], "user_id long, rtt_dl_ms double, handset_type string")
    row = features.user_experience(df).first()
    assert row.avg_rtt_ms == 5.0 and row.avg_throughput_kbps == 0.0


def test_last_handset_skips_nulls_per_column(spark):
    df = spark.createDataFrame(
        [(1, 1, "m1", "t1"), (1, 2, None, "t2"), (1, 3, None, None), (2, 1, None, None)],
        "user_id long, start_ts int, handset_manufacturer string, handset_type string")
    got = {r.user_id: (r.handset_manufacturer, r.handset_type)
           for r in features.user_last_handset(df).collect()}
    assert got == {1: ("m1", "t2"), 2: (None, None)}


def test_modal_handset(spark):
    df = spark.createDataFrame([(1, "z"), (1, "a"), (1, "z"), (1, "a"), (2, None), (3, "q")],
                               "user_id long, handset_type string")
    got = {r.user_id: r.handset_type for r in features.user_modal_handset(df).collect()}
    assert got == {1: "a", 2: "Unknown", 3: "q"}


def test_one_pass_table_equals_the_single_tables(cleaned, users):
    for single in (features.user_engagement(cleaned), features.user_app_traffic(cleaned),
                   features.user_experience(cleaned)):
        columns = sorted(single.columns)
        rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c)
                   for c, t in single.select(columns).dtypes]
        a = set(map(tuple, single.select(columns).select(rounded).collect()))
        b = set(map(tuple, users.select(columns).select(rounded).collect()))
        assert a == b


def test_partitioning_does_not_change_features(sessions):
    a = features.user_last_handset(sessions).collect()
    b = features.user_last_handset(sessions.repartition(9).orderBy(F.rand(3))).collect()
    assert set(map(tuple, a)) == set(map(tuple, b))


def test_parts(cleaned):
    few = features.user_features(cleaned, parts=["engagement"])
    assert "avg_rtt_ms" not in few.columns and "total_traffic_bytes" in few.columns
    with pytest.raises(ValueError):
        features.user_features(cleaned, parts=["nope"])


def test_sums_stay_out_of_rows_per_handset(spark):
    """Sixty sessions on sixty handsets: sixty rows without sums, and one with them a user."""
    df = spark.range(60).select((F.col("id") % 2).alias("user_id"), F.concat(F.lit("h"), "id").alias("h"),
                                (F.col("id") * 1.0).alias("x")).withColumn(
        "h", F.when(F.col("h") != "h7", F.col("h")))
    measures = [features._Measure("n", "count", F.col("x")), features._Measure("x", "mean", F.col("x"))]
    rows = features._per_handset(df, features.DEFAULT, measures, ["h"],
                                 [F.count("*").alias(features.TIMES)])
    assert rows.where("h IS NOT NULL").agg(F.count("*"), F.count("x"), F.sum("n")).first() == (59, 0, 0)
    assert sorted(tuple(r) for r in rows.where("h IS NULL").select("user_id", "x", "n", "`x n`").collect()) \
        == [(0, 870.0, 30, 30), (1, 900.0, 30, 30)]


def test_handsets_of_odd_users(spark):
    """A user without handsets, one without any number, ties, and no user at all."""
    df = spark.createDataFrame(
        [(1, None, 4.0, 1), (1, None, 6.0, 2), (2, "b", None, 1), (2, "a", None, 2), (3, "c", 1.0, 1),
         (3, "c", 3.0, 5), (3, "a", 5.0, 9), (None, "z", 9.0, 1)],
        "user_id long, handset_type string, rtt_dl_ms double, start_ts long").withColumn(
        "handset_manufacturer", F.upper("handset_type"))
    got = features.user_experience(df).select("user_id", "avg_rtt_dl_ms", "handset_type").collect()
    assert sorted(tuple(r) for r in got) == [(1, 5.0, "Unknown"), (2, None, "a"), (3, 3.0, "c")]
    last = features.user_last_handset(df).collect()
    assert sorted(tuple(r) for r in last) == [(1, None, None), (2, "A", "a"), (3, "A", "a")]
