"""K-means rounds over blocks against plain numpy over all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from usagelens.operators import clustering, kmeans
from usagelens.plans.usage import UsagePlan


def rows_frame(n=3000, seed=1):
    """Clusters of uneven size, a point that a third of the rows share, nulls, a far outlier."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) * [1, 5, 0.1] + rng.choice([0, 20, 50], (n, 1), p=[.7, .2, .1])
    x[: n // 3] = x[0]
    x[-1] = 1e4
    df = pd.DataFrame(x.round(3), columns=["a", "b", "c"])
    df["key"] = np.arange(n)
    return df


@pytest.fixture(scope="module")
def pdf():
    return rows_frame()


@pytest.fixture(scope="module")
def table(spark, pdf):
    df = spark.createDataFrame(pdf).repartition(5)
    return df.withColumn("c", F.when(F.col("key") % 50 != 7, F.col("c"))).cache()


@pytest.fixture(scope="module")
def scaled(table):
    rows = table.toPandas().fillna(0.0)
    x = rows[["a", "b", "c"]].to_numpy()
    return (x - x.mean(axis=0)) / x.std(axis=0)


def brute(x, centroids):
    far = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    own = far.argmin(axis=1)
    sums = np.array([[(own == j).sum(), *x[own == j].sum(axis=0)] for j in range(len(centroids))])
    return sums, far.min(axis=1).sum()


def brute_lloyd(x, centroids):
    while True:
        sums, cost = brute(x, centroids)
        after = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centroids)
        if np.abs(after - centroids).max() <= 1e-12:
            return after, cost
        centroids = after


def test_blocks_give_the_sums_and_costs_of_all_rows(table, scaled):
    scale = clustering.fit_scaling(table, ["a", "b", "c"], "standard")
    points = kmeans.Points(table, scale.columns(), block=64)
    rng = np.random.default_rng(2)
    fits = {"one": np.zeros((1, 3)), "tie": np.array([[0.0, 0, 0]] * 3),
            "far": np.array([[900.0, 0, 0], [0, 0, 0]]),
            **{k: scaled[rng.choice(len(scaled), k)] for k in (2, 5, 9)}}
    try:
        sums, costs = points.sums(fits), points.costs(fits)
        assert points.blocks.count() >= len(scaled) // 64 and points.n == len(scaled)
    finally:
        points.release()
    for name, centroids in fits.items():
        expected, cost = brute(scaled, centroids)
        assert np.allclose(sums[name], expected, rtol=1e-9, atol=1e-7), name
        assert np.isclose(costs[name], cost, rtol=1e-9), name
    assert (sums["tie"][1:] == 0).all()


def test_boxes_rule_centroids_out_only_where_no_row_prefers_them():
    rng = np.random.default_rng(3)
    skipped = 0
    for _ in range(300):
        x = rng.normal(rng.normal(0, 3, 2), rng.exponential(0.5), (20, 2))
        places = kmeans.Places([rng.normal(0, 3, (k, 2)) for k in (1, 2, 6)])
        possible = places.possible(x.min(axis=0), x.max(axis=0))
        for c, p in zip(places.split(places.all), places.split(possible[:, None])):
            nearest = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            assert p[nearest].all() and p.any()
            skipped += len(p) > 1 and p.sum() == 1
    assert skipped > 150  # such blocks are settled without a look at their rows


def test_lloyd_many_equals_plain_rounds(table, scaled):
    fits = clustering.lloyd_many(table, "key", ["a", "b", "c"], [2, 4, 7], "standard")
    scale = fits[2].scaling
    starts = clustering.seed_rows(table, "key", scale, [2, 4, 7])
    for k, fit in fits.items():
        expected, _ = brute_lloyd(scaled, np.array(starts[k]))
        assert np.allclose(fit.centroids, expected, atol=1e-9)


def test_restarts_keep_the_cheapest_settled_fit(table, scaled):
    found = clustering.restarted_many(table, "key", ["a", "b", "c"], [2, 3, 5], "standard",
                                      restarts=4, order_by="b")
    again = clustering.restarted_many(table.repartition(9), "key", ["a", "b", "c"], [2, 3, 5],
                                      "standard", restarts=4, order_by="b")
    for k, fit in found.items():
        centroids = np.array(fit.segmentation.centroids)
        sums, cost = brute(scaled, centroids)
        assert len(fit.costs) == 4 and fit.cost == min(fit.costs) <= fit.costs[0]
        assert np.isclose(cost, fit.cost, rtol=1e-9)
        held = sums[:, 0] > 0
        assert np.allclose((sums[:, 1:] / np.maximum(sums[:, :1], 1))[held], centroids[held], atol=1e-9)
        assert (np.diff(centroids[:, 1]) >= 0).all()
        assert np.allclose(again[k].segmentation.centroids, centroids, atol=1e-9)


def test_more_clusters_than_points_and_no_rows(spark):
    few = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0)], "key long, v double")
    found = clustering.restarted(few, "key", ["v"], 3)
    assert found.cost == 0 and len(found.segmentation.centroids) == 3
    with pytest.raises(ValueError):
        clustering.restarted(few.limit(0), "key", ["v"], 2)


def test_drawn_starts_are_rows_and_repeat():
    sample = np.random.default_rng(5).normal(size=(50, 2))
    a, b = (kmeans.drawn_start(sample, 6, (1, 6, 2)) for _ in range(2))
    assert (a == b).all() and all((sample == row).all(axis=1).any() for row in a)
    assert len(np.unique(a, axis=0)) == 6
    assert len(kmeans.drawn_start(sample[:1], 3, (0,))) == 3


def test_the_plan_uses_restarts_by_default(sessions):
    usage, rank = UsagePlan(sessions, restarts=3), UsagePlan(sessions, method="lloyd")
    for name in ("engagement", "experience"):
        fits = [getattr(p, f"_{name}_fit") for p in (usage, rank)]
        costs = [clustering.inertia(getattr(usage, name), {3: f})[3] for f in fits]
        assert costs[0] <= costs[1] * (1 + 1e-12)
    assert usage.satisfaction_clustered.select("satisfaction_cluster").distinct().count() == 2


def test_fits_go_on_until_they_stand_still(spark):
    """Evenly spread rows need more rounds than any fixed number fit for smaller tables."""
    x = np.linspace(0, 1, 20_000)
    points = kmeans.Points(spark.createDataFrame(pd.DataFrame({"x": x})), [F.col("x")])
    try:
        starts = {0: np.linspace(0, 0.01, 20)[:, None]}
        found = kmeans.settle(points, starts, clustering.STILL)[0]
        with pytest.raises(RuntimeError, match="after 5 rounds"):
            kmeans.settle(points, starts, clustering.STILL, 5)
    finally:
        points.release()
    assert np.allclose(brute_lloyd(x[:, None], found)[0], found, atol=1e-9)


class Turning:
    """Sums that alternate between two neighbouring centroids, as rounding can."""

    def sums(self, fits):
        return {f: np.array([[2.0, 3.0 if c[0, 0] < 1.25 else 2.0]]) for f, c in fits.items()}


def test_a_fit_that_returns_stands_still_and_values_must_be_finite():
    assert kmeans.settle(Turning(), {0: np.array([[0.0]])}, 1e-12)[0][0, 0] in (1.0, 1.5)

    class Broken(Turning):
        def sums(self, fits):
            return {f: np.array([[2.0, np.nan]]) for f in fits}

    with pytest.raises(RuntimeError, match="not finite"):
        kmeans.settle(Broken(), {0: np.array([[0.0]])}, 1e-12)
