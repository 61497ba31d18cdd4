import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.operators import clustering, models, reports, scoring
from usagelens.plans.usage import UsagePlan
from usagelens.schema import ENGAGEMENT_METRICS, EXPERIENCE_METRICS


@pytest.fixture(scope="module")
def analysis(sessions):
    return UsagePlan(sessions, method="lloyd")


@pytest.fixture(scope="module")
def scores(analysis):
    return analysis.satisfaction.persist()


def numpy_lloyd(x, ids, k, rounds=300):
    order = np.lexsort((ids, x[:, 0]))
    n = len(x)
    c = x[order[[-(-n * (2 * i + 1) // (2 * k)) - 1 for i in range(k)]]]
    for _ in range(rounds):
        lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
    return ((x[:, None] - c[None]) ** 2).sum(2).argmin(1), c


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_lloyd_matches_numpy(users, k):
    pdf = users.select("user_id", *ENGAGEMENT_METRICS).toPandas()
    x = pdf[list(ENGAGEMENT_METRICS)].to_numpy(float)
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    want, _ = numpy_lloyd(x, pdf.user_id.to_numpy(), k)
    fit = clustering.lloyd(users, "user_id", ENGAGEMENT_METRICS, k)
    got = fit.assign(users, "c").select("user_id", "c").toPandas().set_index("user_id").c
    assert (got.loc[pdf.user_id].to_numpy() == want).all()


def test_one_more_step_changes_nothing(users):
    fit = clustering.lloyd(users, "user_id", ENGAGEMENT_METRICS, 3)
    pdf = fit.assign(users, "c").select("c", *ENGAGEMENT_METRICS).toPandas()
    x = pdf[list(ENGAGEMENT_METRICS)].to_numpy(float)
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    means = np.array([x[pdf.c == i].mean(0) for i in range(3)])
    assert np.allclose(means, fit.centroids, atol=1e-10)
    assert (((x[:, None] - means[None]) ** 2).sum(2).argmin(1) == pdf.c).all()


@pytest.mark.parametrize("kind", ["double", "decimal(12,0)", "string"])
def test_lloyd_takes_any_key_type(users, kind):
    fit = clustering.lloyd(users.withColumn("user_id", F.col("user_id").cast(kind)), "user_id",
                           ENGAGEMENT_METRICS, 2)
    assert len(fit.centroids) == 2


def test_duplicate_points_leave_clusters_empty_without_failing(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)], "user_id long, m double")
    fit = clustering.lloyd(df, "user_id", ["m"], 3)
    assert {r.c for r in fit.assign(df, "c").collect()} == {0}


def test_ml_kmeans_orders_ids_by_the_named_metric(users):
    fit = clustering.kmeans(users, ENGAGEMENT_METRICS, 3, restarts=2, order_by="total_traffic_bytes")
    means = [r.total_traffic_bytes for r in clustering.cluster_means(
        fit.assign(users, "c"), "c", ENGAGEMENT_METRICS).orderBy("c").collect()]
    assert len(means) == 3 and means == sorted(means)


@pytest.mark.parametrize("method", ["lloyd", "ml"])
def test_elbow(users, method):
    rows = clustering.elbow(users, "user_id", ENGAGEMENT_METRICS, 5, method=method).collect()
    inertias = [r.inertia for r in sorted(rows, key=lambda r: r.k)]
    assert len(inertias) == 5 and 1 <= rows[0].optimal_k <= 5
    assert rows[0].optimal_k == int(np.argmax(np.diff(np.diff(inertias))) + 2)
    x = users.select(*ENGAGEMENT_METRICS).toPandas().to_numpy(float)
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    assert inertias[0] == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_fits_of_ml_keep_their_own_vectors(users, monkeypatch):
    """Over a table that is held as vectors every iteration would decode all rows again."""
    fit, seen = clustering.KMeans.fit, []

    def watched(self, vectors, *args):
        seen.append(vectors.storageLevel)
        return fit(self, vectors, *args)

    monkeypatch.setattr(clustering.KMeans, "fit", watched)
    clustering.elbow(users, "user_id", ENGAGEMENT_METRICS, 3, method="ml", restarts=2)
    assert len(seen) == 4 and not any(level.useMemory or level.useDisk for level in seen)


def test_elbow_of_one_cluster_only(users):
    row = clustering.elbow(users, "user_id", ENGAGEMENT_METRICS, 1).first()
    assert row.k == 1 and row.optimal_k is None


def test_shares_and_statistics(analysis):
    clustered = analysis.engagement_clustered
    share = clustering.cluster_share(clustered, "engagement_cluster", ENGAGEMENT_METRICS)
    assert share.count() == 3
    assert share.agg(F.sum("user_pct"), F.sum("total_traffic_bytes_pct")).first() \
        == pytest.approx((100, 100))
    stats = clustering.cluster_statistics(clustered, "engagement_cluster", ENGAGEMENT_METRICS)
    assert stats.where("sessions_frequency_min > sessions_frequency_max").isEmpty()
    dist = clustering.cluster_distribution(analysis.experience_clustered, "experience_cluster",
                                           EXPERIENCE_METRICS)
    assert dist.agg(F.sum("user_pct")).first()[0] == pytest.approx(100)


def test_labels_follow_the_order(analysis):
    assert {r.label for r in analysis.engagement_labels.collect()} == {"Low", "Medium", "High"}
    means = {r.experience_cluster: r.avg_tcp_retransmission for r in clustering.cluster_means(
        analysis.experience_clustered, "experience_cluster", EXPERIENCE_METRICS).collect()}
    by_label = {r.label: means[r.experience_cluster] for r in analysis.experience_labels.collect()}
    assert by_label["Good"] <= by_label["Average"] <= by_label["Poor"]


def test_other_cluster_counts_get_tiers(users):
    fit = clustering.lloyd(users, "user_id", ENGAGEMENT_METRICS, 4)
    labels = clustering.engagement_labels(fit.assign(users, "c"), "c", ENGAGEMENT_METRICS)
    assert {r.label for r in labels.collect()} == {f"Tier-{i}" for i in range(1, 5)}


def test_boxes_and_grids_cover_all_users(analysis):
    n = analysis.users.count()
    boxes = clustering.cluster_boxes(analysis.experience_clustered, "experience_cluster",
                                     EXPERIENCE_METRICS)
    assert boxes.groupBy("metric").agg(F.sum("count").alias("n")).where(f"n <> {n}").isEmpty()
    grid = clustering.cluster_grid(analysis.engagement_clustered, "engagement_cluster",
                                   [("sessions_frequency", "total_traffic_bytes")])
    assert grid.agg(F.sum("count")).first()[0] == n


def test_scores_match_numpy(analysis):
    pdf = analysis.engagement_clustered.toPandas()
    x = pdf[list(ENGAGEMENT_METRICS)].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    low = pdf.groupby("engagement_cluster").total_traffic_bytes.mean().idxmin()
    want = np.linalg.norm(z - z[pdf.engagement_cluster == low].mean(0), axis=1)
    got = scoring.engagement_score(analysis.engagement_clustered).toPandas().set_index("user_id")
    assert np.allclose(got.loc[pdf.user_id].engagement_score, want)


def test_satisfaction_table(scores):
    assert scores.where("engagement_score < 0 OR experience_score < 0").isEmpty()
    assert scores.where("abs(satisfaction_score - (engagement_score + experience_score) / 2) > 1e-12"
                        ).isEmpty()
    top = [r.satisfaction_score for r in scoring.top_satisfied(scores).collect()]
    assert len(top) == 10 and top == sorted(top, reverse=True)


def test_scoring_needs_clusters(users):
    with pytest.raises(ValueError):
        scoring.engagement_score(users)


def test_descriptions(analysis):
    rows = scoring.describe_satisfaction(analysis.satisfaction_clustered,
                                         analysis.satisfaction_segmentation).collect()
    low, high = sorted(rows, key=lambda r: r.satisfaction_score)
    assert low.label.startswith("Low") and high.label.startswith("High")
    assert "intervention" in low.insight and "VIP" in high.insight
    fit = clustering.lloyd(analysis.satisfaction, "user_id", scoring.SCORE_FEATURES, 4, "standard")
    tiers = scoring.describe_satisfaction(fit.assign(analysis.satisfaction, "satisfaction_cluster"), fit)
    assert {r.insight for r in tiers.collect()} == {scoring.DEFAULT_INSIGHT}


def test_reports(analysis, scores):
    seg = reports.engagement_segments(analysis.engagement_clustered, analysis.engagement_labels)
    assert [r.classification for r in seg.collect()] == ["Low", "Medium", "High"]
    find = reports.engagement_key_finding(analysis.engagement_clustered,
                                          analysis.engagement_labels).first()
    assert find.session_ratio > 1 and 0 < find.high_user_pct < 100
    seg = reports.experience_segments(analysis.experience_clustered, analysis.experience_labels)
    assert [r.classification for r in seg.collect()] == ["Good", "Average", "Poor"]
    assert reports.experience_key_finding(analysis.experience_clustered,
                                          analysis.experience_labels).first().tcp_gap >= 1
    assert reports.means_long(analysis.engagement_clustered, analysis.engagement_labels,
                              "engagement_cluster", ENGAGEMENT_METRICS).count() == 9
    density = reports.score_density(scores).selectExpr("sum(density * (bin_end - bin_start))").first()
    assert density[0] == pytest.approx(1)
    assert reports.score_distribution(scores).first()["count"] == scores.count()
    assert reports.score_space_grid(scores).agg(F.sum("users")).first()[0] == scores.count()
    assert reports.default_inputs(scores).first().engagement_score > 0


def test_key_finding_without_low_sessions_is_infinite(spark):
    users = spark.createDataFrame([(0, 0.0, 1.0, 0.0), (1, 5.0, 2.0, 9.0)],
                                  "c int, sessions_frequency double, total_duration_ms double, "
                                  "total_traffic_bytes double")
    labels = spark.createDataFrame([(0, 1, "Low"), (1, 2, "High")], "c int, rank int, label string")
    row = reports.engagement_key_finding(users, labels, "c").first()
    assert row.session_ratio == row.traffic_ratio == float("inf")


def test_labelled_users(analysis):
    named = clustering.labelled(analysis.engagement_clustered, analysis.engagement_labels,
                                "engagement_cluster", "segment")
    assert {r.segment.split(" - ")[1] for r in named.collect()} == {"Low", "Medium", "High"}


# -- models ------------------------------------------------------------------

@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(0)
    e, x = rng.uniform(0, 100, 200), rng.uniform(0, 100, 200)
    y = (e + x) / 2 + rng.normal(0, 5, 200)
    return spark.createDataFrame(
        [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(e, x, y))],
        "user_id long, engagement_score double, experience_score double, satisfaction_score double"
    ).repartition(3).persist()


def numpy_ridge(pdf, alpha=1.0):
    x, y = pdf[["engagement_score", "experience_score"]].to_numpy(), pdf.satisfaction_score.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
    return b, y.mean() - b @ x.mean(0)


def test_ridge_is_exact(noisy):
    b, b0 = numpy_ridge(noisy.toPandas())
    fit = models.fit_ridge(noisy)
    assert np.allclose([*fit.coefficients, fit.intercept], [*b, b0])


def test_ridge_cv_matches_contiguous_folds(noisy):
    pdf = noisy.toPandas().sort_values("user_id").reset_index(drop=True)
    got = {r.fold: r.rmse for r in models.ridge_cv(noisy, "user_id").collect()}
    for i, test in enumerate(np.array_split(np.arange(200), 5)):
        b, b0 = numpy_ridge(pdf.drop(test))
        t = pdf.loc[test]
        e = t.satisfaction_score - t[["engagement_score", "experience_score"]].to_numpy() @ b - b0
        assert got[i] == pytest.approx(np.sqrt((e ** 2).mean()))


def test_split_ignores_partitioning(noisy):
    a = {r.user_id for r in models.train_test_split(noisy, "user_id")[1].collect()}
    b = {r.user_id for r in models.train_test_split(noisy.repartition(11), "user_id")[1].collect()}
    assert a == b and 20 < len(a) < 60


@pytest.mark.parametrize("name", ["gradient_boosting", "random_forest", "ridge"])
def test_train_store_load_score(spark, noisy, tmp_path, name):
    params = {} if name == "ridge" else {"n_estimators": 5}
    model, record = models.train(noisy, name, params=params, with_cv=False)
    row = record.first()
    assert row.model_name == name and row.train_rows + row.test_rows == 200
    assert row.rmse < 30 and row.r2 <= 1
    path = str(tmp_path / name)
    models.save_model(noisy, model, path)
    loaded = models.load_model(spark, path)
    a = {r.user_id: r.predicted_satisfaction for r in models.score(noisy, model).collect()}
    b = {r.user_id: r.predicted_satisfaction for r in models.score(noisy, loaded).collect()}
    assert a == pytest.approx(b) and len(a) == 200


def test_missing_model_falls_back_to_the_average(spark, noisy, tmp_path):
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "none"))
    scored = models.score_or_average(noisy, str(tmp_path / "none"))
    assert scored.where("abs(predicted_satisfaction - (engagement_score + experience_score) / 2) > 1e-12"
                        ).isEmpty()


def test_comparison_and_runs_table(spark, noisy, tmp_path):
    table = models.train_all(noisy, names=("ridge", "random_forest"), params={"n_estimators": 5},
                             with_cv=False)
    rmses = [r.rmse for r in table.collect()]
    assert rmses == sorted(rmses)
    path = str(tmp_path / "runs")
    for _ in range(2):
        models.append_run(models.train(noisy, "ridge")[1], path)
    runs = spark.read.parquet(path)
    assert runs.count() == 2 and runs.where("cv_rmse IS NULL").isEmpty()


def test_tree_cv(noisy):
    rows = models.cross_validate(noisy, "user_id", "gradient_boosting",
                                 params={"n_estimators": 3}).collect()
    assert sorted(r.fold for r in rows) == list(range(5)) and all(r.rmse > 0 for r in rows)


def test_metrics_match_numpy(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)],
                               "satisfaction_score double, predicted_satisfaction double")
    r = models.regression_metrics(df).first()
    assert (r.mse, r.mae) == pytest.approx((1.25 / 3, 0.5))
    assert r.r2 == pytest.approx(1 - 1.25 / ((np.array([1, 2, 4]) - 7 / 3) ** 2).sum())


def test_unknown_names_are_refused(noisy, sessions):
    with pytest.raises(ValueError):
        models.fit_model(noisy, "crystal_ball")
    with pytest.raises(ValueError):
        UsagePlan(sessions, method="guess")
