"""Histogram boosting against row-by-row trees in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from usagelens.operators import boosting, models


def rows_frame(n=600, seed=4):
    """A third of the rows are alike; some features and targets are missing."""
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"key": np.arange(n), "u": rng.exponential(2, n).round(2),
                       "v": rng.choice([1.0, 2.0, 3.0, 7.0], n)})
    df.loc[: n // 3, ["u", "v"]] = 1.5, 2.0
    df["y"] = np.sin(df.u) + (df.v > 2) * 0.7 + rng.normal(0, 0.1, n)
    return df


@pytest.fixture(scope="module")
def pdf():
    df = rows_frame()
    df.loc[df.key % 40 == 3, "u"] = None
    df.loc[df.key % 90 == 5, "y"] = None
    return df


@pytest.fixture(scope="module")
def table(spark, pdf):
    df = spark.createDataFrame(pdf).repartition(4)
    return df.select("key", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("u", "v", "y")]).cache()


def brute_edges(x, bins):
    x = np.sort(x)
    return np.unique([x[-(-len(x) * i // bins) - 1] for i in range(1, bins)])


def brute_tree(x, r, edges, depth, rate, node=1):
    """Nodes of a tree that looks at every split of every row."""
    best = None
    if depth:
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = x[:, f] <= e
                if left.any() and not left.all():
                    gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() \
                        - r.sum() ** 2 / len(r)
                    if gain > 1e-10 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, float(e), left
    if best is None:
        return {}, {node: rate * r.mean()}
    _, f, e, left = best
    splits, values = {node: (f, e)}, {}
    for side, child in ((left, 2 * node), (~left, 2 * node + 1)):
        s, v = brute_tree(x[side], r[side], edges, depth - 1, rate, child)
        splits |= s
        values |= v
    return splits, values


def predicted(x, start, trees):
    out = np.full(len(x), start)
    for splits, values in trees:
        for i, row in enumerate(x):
            node = 1
            while node in splits:
                f, e = splits[node]
                node = 2 * node + (row[f] > e)
            out[i] += values[node]
    return out


def brute_boost(pdf, train, n_trees, rate, depth, bins):
    x, y = pdf[["u", "v"]].fillna(0.0).to_numpy(), pdf.y.to_numpy()
    edges = [brute_edges(x[:, f], bins) for f in range(2)]
    use = train & ~np.isnan(y)
    guess, trees, start = np.full(len(x), y[use].mean()), [], y[use].mean()
    for _ in range(n_trees):
        tree = brute_tree(x[use], (y - guess)[use], edges, depth, rate)
        trees.append(tree)
        guess = predicted(x, start, trees)
    return start, trees, guess


def test_models_of_one_training_equal_trees_over_rows(table, pdf, monkeypatch):
    monkeypatch.setattr(boosting, "SAVED", 2)
    members = [F.lit(True), F.col("key") % 3 != 0, F.col("key") % 3 != 1]
    trains = [np.ones(len(pdf), bool), pdf.key.to_numpy() % 3 != 0, pdf.key.to_numpy() % 3 != 1]
    found = boosting.boost(table, ["u", "v"], "y", "key", members, 5, 0.3, 3, 16)
    for m, (model, train) in enumerate(zip(found.models, trains)):
        start, trees, guess = brute_boost(pdf, train, 5, 0.3, 3, 16)
        assert np.isclose(model.start, start)
        for mine, (splits, values) in zip(model.trees, trees):
            assert mine.splits == splits
            assert mine.values.keys() == values.keys()
            assert all(np.isclose(mine.values[n], values[n]) for n in values)
        unseen = ~train & ~pdf.y.isna().to_numpy()
        assert found.unseen_rows[m] == unseen.sum()
        if unseen.any():
            error = (pdf.y.to_numpy() - guess)[unseen]
            assert np.isclose(found.unseen_rmse[m], np.sqrt((error ** 2).mean()))
        else:
            assert found.unseen_rmse[m] is None


def test_expression_store_and_load(spark, table, pdf, tmp_path):
    model = boosting.boost(table, ["u", "v"], "y", "key", [F.lit(True)], 4, 0.3, 3, 16).models[0]
    start, trees, guess = brute_boost(pdf, np.ones(len(pdf), bool), 4, 0.3, 3, 16)
    path = str(tmp_path / "model")
    models.save_model(table, model, path)
    for m in (model, models.load_model(spark, path)):
        scored = models.score(table, m)
        rows = {r.key: r[models.PREDICTION] for r in scored.collect()}
        assert np.allclose([rows[k] for k in pdf.key], guess)
        assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    kept = boosting.Boosted.load(spark, path)
    assert kept.start == model.start and len(kept.trees) == 4
    assert {t.values.keys() == u.values.keys() for t, u in zip(kept.trees, model.trees)} == {True}


def test_flat_targets_and_features_do_not_split(spark):
    flat = spark.createDataFrame([(i, float(i), 4.0) for i in range(20)], "key long, u double, y double")
    same = flat.withColumns({"u": F.lit(1.0), "y": F.col("key").cast("double")})
    for df, mean in ((flat, 4.0), (same, 9.5)):
        model = boosting.boost(df, ["u"], "y", "key", [F.lit(True)], 2).models[0]
        assert model.start == mean and all(not t.splits and t.values == {1: 0.0} for t in model.trees)
    with pytest.raises(ValueError):
        boosting.boost(flat.limit(0), ["u"], "y", "key", [F.lit(True)], 2)
    with pytest.raises(ValueError):
        boosting.boost(flat, ["u"], "y", "key", [F.lit(True), F.lit(False)], 2)


def test_equal_gains_take_the_first_feature_and_smallest_edge():
    histogram = np.zeros((2, 4, 2))
    histogram[:, 0], histogram[:, 3] = (5, 5.0), (5, -5.0)
    assert boosting.best_split(histogram) == (0, 0, [1.0, -1.0])
    assert boosting.best_split(histogram * [1, 0]) is None


def test_hold_out_and_folds_come_from_one_training(table):
    named = table.withColumnsRenamed({"u": "engagement_score", "v": "experience_score",
                                      "y": "satisfaction_score"})
    params = {**models.CANDIDATES["gradient_boosting"], "n_estimators": 2}
    together = models.boosted_hold_out(named, "key", models.SCORE_FEATURES, models.TARGET, params, True)
    alone = models.boosted_hold_out(named, "key", models.SCORE_FEATURES, models.TARGET, params, False)
    folds = models.cross_validate(named, "key", "gradient_boosting", params={"n_estimators": 2}).collect()
    assert alone[1] is None and np.isclose(together[0].start, alone[0].start)
    for a, b in zip(together[0].trees, alone[0].trees):
        assert a.splits == b.splits and a.values.keys() == b.values.keys()
        assert all(np.isclose(a.values[n], b.values[n]) for n in a.values)
    assert np.isclose(together[1], np.mean([r.rmse for r in folds]))
    assert [r.fold for r in sorted(folds)] == list(range(models.FOLDS))
