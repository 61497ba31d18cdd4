import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from usagelens.functions.orderstats import RankPolicy, exact_quantiles, order_statistics
from usagelens.operators.models import with_fold
from usagelens.operators.segments import decile_segmentation, with_decile

POLICIES = [RankPolicy(), RankPolicy(accuracy=20, max_candidates=10, grid=8),
            RankPolicy(accuracy=5, max_candidates=1, grid=2)]


def frame(spark, groups):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "variable string, value double").repartition(4)


def groups():
    rng = np.random.default_rng(1)
    skewed = rng.lognormal(0, 3, 3000)
    skewed[:1000] = 42.0  # a third of all rows share one value
    return {"uniform": rng.uniform(-5, 5, 2000), "skewed": skewed, "one": [3.0],
            "two": [1.0, 2.0], "flat": [7.0] * 50, "binary": [0.0] * 700 + [1.0] * 300}


@pytest.mark.parametrize("policy", POLICIES)
def test_quantiles_equal_numpy(spark, policy):
    data, ps = groups(), [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(frame(spark, data), ps, policy=policy)
    for k, values in data.items():
        assert np.allclose(got[k], np.quantile(values, ps), rtol=1e-12), k


@pytest.mark.parametrize("policy", POLICIES)
def test_cuts_report_rows_below_and_ties(spark, policy):
    data = groups()
    found = order_statistics(frame(spark, data), [0.4], lambda _, n: [(0, r := math.ceil(0.4 * n), r)],
                             policy=policy)
    for k, values in data.items():
        cut = found[k].cuts[0][0]
        assert cut.value == np.sort(values)[cut.rank - 1]
        assert cut.below == (np.asarray(values) < cut.value).sum()
        assert cut.ties == (np.asarray(values) == cut.value).sum()


def test_misleading_hints_are_corrected(spark):
    """A wrong first bracket costs passes, never the result."""
    data = {"x": np.arange(1000.0)}
    found = order_statistics(frame(spark, data), [0.9], lambda _, n: [(0, 5, 5)])
    assert found["x"].cuts[0][0].value == 4.0


def duration_frame(spark, durations):
    rows = [(i, float(d), float(i)) for i, d in enumerate(durations)]
    return spark.createDataFrame(
        rows, "user_id long, total_duration_ms double, total_data_bytes double").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 107, 1003])
@pytest.mark.parametrize("distinct", [3, 10_000])
def test_deciles_equal_pandas_qcut(spark, n, distinct):
    durations = np.random.default_rng(n).integers(0, distinct, n)
    got = {r.user_id: r.decile_num for r in
           with_decile(duration_frame(spark, durations)).collect()}
    if n == 1:
        assert got == {0: 1}
        return
    rank = pd.Series(durations).rank(method="first")
    want = pd.qcut(rank, 10, labels=False) + 1
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,2)"])
def test_ties_follow_the_key_itself(spark, kind):
    durations = np.random.default_rng(3).integers(0, 3, 211)
    keyed = duration_frame(spark, durations).withColumn("user_id", F.col("user_id").cast(kind))
    rows = with_decile(keyed).collect()
    table = pd.DataFrame([(r.user_id, r.total_duration_ms, r.decile_num) for r in rows],
                         columns=["user", "duration", "decile"]).sort_values(["duration", "user"])
    want = pd.qcut(np.arange(1, len(table) + 1), 10, labels=False) + 1
    assert (table.decile.to_numpy() == want).all()
    folds = sorted((r.user_id, r.fold) for r in with_fold(keyed, "user_id").collect())
    assert [f for _, f in folds] == sorted(f for _, f in folds)


def test_rows_without_a_key_are_left_out(spark):
    rows = [("a", 1.0), (None, 5.0), ("a", 3.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "variable string, value double")
    assert exact_quantiles(df, [0.5]) == {"a": [2.0]}


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_many_keys(spark, accuracy):
    df = spark.range(30_000).select((F.col("id") % 3000).cast("string").alias("variable"),
                                    F.col("id").cast("double").alias("value"))
    got = exact_quantiles(df, [0.5], policy=RankPolicy(accuracy=accuracy))
    assert len(got) == 3000 and got["7"] == [7 + 3000 * 4.5]


def test_segmentation_keeps_the_upper_deciles_in_text_order(spark):
    table = decile_segmentation(duration_frame(spark, range(100))).collect()
    assert [r.decile for r in table] == ["D10", "D6", "D7", "D8", "D9"]
    assert sum(r.total_data_bytes_sum for r in table) == sum(range(50, 100))


@pytest.mark.parametrize("n", [5, 7, 103])
def test_contiguous_folds_follow_key_order(spark, n):
    rows = with_fold(spark.range(n).withColumnRenamed("id", "user_id"), "user_id") \
        .orderBy("user_id").collect()
    folds = [r.fold for r in rows]
    assert folds == sorted(folds)
    assert [folds.count(i) for i in range(5)] == [n // 5 + (i < n % 5) for i in range(5)]


def test_fold_modes(spark):
    df = spark.range(50).withColumnRenamed("id", "user_id")
    hashed = with_fold(df, "user_id", mode="hash")
    assert {r.fold for r in hashed.collect()} <= set(range(5))
    with pytest.raises(ValueError):
        with_fold(df, "user_id", mode="odd")
    with pytest.raises(ValueError):
        with_fold(df.where("user_id < 3"), "user_id")
