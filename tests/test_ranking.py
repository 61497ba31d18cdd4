import pytest
from pyspark.sql import functions as F

from usagelens.operators import ranking, reports


def test_top_handsets_match_pandas(sessions, raw):
    got = {r.handset_type: r.session_count for r in ranking.top_handsets(sessions).collect()}
    assert got == raw.handset_type.dropna().value_counts().to_dict()


def test_manufacturer_counts_include_sessions_without_a_type(sessions, raw):
    got = ranking.top_handsets_per_manufacturer(sessions, n_manufacturers=2, n_handsets=3).collect()
    counts = raw.handset_manufacturer.value_counts()
    leaders = sorted(counts.index, key=lambda m: (-counts[m], m))[:2]
    assert {r.handset_manufacturer for r in got} == set(leaders)
    for make in leaders:
        want = raw[raw.handset_manufacturer == make].handset_type.value_counts().head(3)
        mine = {r.handset_type: r.session_count for r in got if r.handset_manufacturer == make}
        assert sorted(mine.values(), reverse=True) == list(want.values)


def test_market_share_adds_up(sessions):
    assert ranking.market_share(sessions).agg(F.sum("share_pct")).first()[0] == pytest.approx(100)


def test_top_per_metric_matches_pandas_and_breaks_ties_by_user(spark, users):
    table = users.toPandas()
    got = ranking.top_engaged(users).collect()
    for metric in ("sessions_frequency", "total_duration_ms", "total_traffic_bytes"):
        want = table.sort_values([metric, "user_id"], ascending=[False, True]).head(10)
        mine = sorted((r for r in got if r.metric == metric), key=lambda r: r["rank"])
        assert [r.user_id for r in mine] == list(want.user_id)
    tied = spark.createDataFrame([(i, 5.0) for i in range(30)], "user_id long, total_traffic_bytes double")
    assert [r.user_id for r in ranking.top_engaged(tied.repartition(5)).orderBy("rank").collect()] \
        == list(range(10))


def test_top_per_application_and_top_applications(users):
    rows = ranking.top_per_application(users).collect()
    assert len({r.application for r in rows}) == 7 and "google" in {r.application for r in rows}
    top = ranking.top_applications(users).collect()
    assert len(top) == 3 and top[0].total_bytes >= top[1].total_bytes >= top[2].total_bytes


def test_extremes(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 5.0), (4, None), (5, 2.0)],
                               "user_id long, avg_rtt_ms double")
    rows = ranking.top_bottom_frequent(df, "avg_rtt_ms", n=2).collect()
    pick = lambda kind: [(r.user_id, r.value, r["count"]) for r in
                         sorted(rows, key=lambda r: r["rank"]) if r.kind == kind]
    assert pick("top") == [(1, 5.0, None), (3, 5.0, None)]
    assert pick("bottom") == [(2, 1.0, None), (5, 2.0, None)]
    assert pick("most_frequent") == [(None, 5.0, 2), (None, 1.0, 1)]
    with pytest.raises(KeyError):
        ranking.top_bottom_frequent(df, "nope")


def test_summary_has_all_metrics(users):
    rows = ranking.experience_extremes(users).collect()
    assert {r.metric for r in rows} == {"avg_tcp_retransmission", "avg_rtt_ms", "avg_throughput_kbps"}
    assert {r.kind for r in rows} == {"top", "bottom", "most_frequent"}


def test_handset_means_and_gaps(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 0.5), ("a", 30.0, 0.5), ("b", 5.0, 40.0), (None, 99.0, 1.0)],
        "handset_type string, avg_throughput_kbps double, avg_tcp_retransmission double")
    assert [tuple(r) for r in ranking.throughput_per_handset(df).collect()] == [("a", 20.0), ("b", 5.0)]
    assert [r[0] for r in ranking.throughput_bottom_handsets(df).collect()] == ["b", "a"]
    assert ranking.tcp_per_handset(df, n=1).first()[0] == "b"
    assert ranking.tcp_best_handsets(df, n=1).first()[0] == "a"
    assert tuple(ranking.throughput_gap(df).first()) == ("a", "b", 4.0)
    assert tuple(ranking.tcp_gap(df).first()) == ("b", "a", 40.0)  # divisor raised to one
    still = df.withColumn("avg_throughput_kbps", F.lit(0.0))
    assert ranking.throughput_gap(still).first().gap == float("inf")
    with pytest.raises(KeyError):
        ranking.tcp_per_handset(df.drop("avg_tcp_retransmission"))


def test_kpis(sessions, raw, users):
    row = reports.kpi_banner(sessions).first()
    assert row.total_records == len(raw) and row.unique_users == raw.user_id.nunique()
    assert row.handset_types == raw.handset_type.nunique()
    assert row.total_dl_tb == pytest.approx(raw.total_dl.sum() / 1e12)
    assert reports.experience_kpis(users).first().users == users.count()
    shown = [r.user_id for r in reports.experience_preview(users).collect()]
    assert len(shown) == 20 and shown == sorted(shown)
