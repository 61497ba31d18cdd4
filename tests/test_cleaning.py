import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from session_helpers import to_spark
from usagelens.functions.orderstats import RankPolicy
from usagelens.operators import cleaning
from usagelens.schema import DEFAULT

MEASURE = "tp_dl_kbps"


def expected_clean(raw: pd.DataFrame, c: str) -> pd.Series:
    x = raw[c].fillna(raw[c].mean())
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    out = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    return x.where(~out, x[~out].mean())


def test_nothing_missing_after_cleaning(cleaned):
    numeric = [c for c in DEFAULT.numeric(cleaned, skip_ids=True)]
    texts = DEFAULT.categorical(cleaned)
    row = cleaned.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c)
                        for c in numeric + texts]).first()
    assert set(row.asDict().values()) == {0}


@pytest.mark.parametrize("column", ["rtt_dl_ms", "tcp_dl_bytes", MEASURE, "dur_ms"])
def test_values_match_pandas(cleaned, raw, column):
    got = sorted(r[0] for r in cleaned.select(column).collect())
    assert np.allclose(got, sorted(expected_clean(raw, column)))


def test_total_is_the_sum_of_both_directions(cleaned):
    assert cleaned.where("abs(total_data - total_dl - total_ul) > 1e-6").isEmpty()


def test_sketch_settings_do_not_change_the_result(sessions):
    coarse = cleaning.fit_cleaning(sessions, policy=RankPolicy(20, 10, 8))
    fine = cleaning.fit_cleaning(sessions)
    assert coarse.fences.keys() == fine.fences.keys()
    for c, fence in fine.fences.items():
        assert (coarse.fences[c].low, coarse.fences[c].high) == (fence.low, fence.high)


def test_row_order_and_partitions_do_not_matter(sessions):
    a = cleaning.fit_cleaning(sessions)
    b = cleaning.fit_cleaning(sessions.repartition(7).orderBy(F.rand(1)))
    assert a.modes == b.modes
    assert np.allclose(list(a.means.values()), [b.means[c] for c in a.means])


def test_mode_tie_takes_the_smallest_and_empty_becomes_unknown(spark):
    df = spark.createDataFrame([("z", None), ("a", None), ("z", None), ("a", None), (None, None)],
                               "handset_type string, handset_manufacturer string")
    rows = cleaning.impute(df).collect()
    assert sorted(r.handset_type for r in rows) == ["a", "a", "a", "z", "z"]
    assert {r.handset_manufacturer for r in rows} == {"Unknown"}


def test_zero_inflated_column_keeps_only_zeros(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(5.0,)], "other_dl double")
    assert {r[0] for r in cleaning.replace_outliers(df).collect()} == {0.0}


def test_empty_and_constant_columns_survive(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "rtt_dl_ms double, dur_ms double")
    rows = cleaning.clean(df).collect()
    assert [(r.rtt_dl_ms, r.dur_ms) for r in rows] == [(None, 2.0)] * 2


def test_id_policies(spark):
    df = spark.createDataFrame([(1, 1.0), (3, 2.0), (None, 3.0)], "user_id long, dur_ms double")
    drop = {r.user_id for r in cleaning.clean(df).collect()}
    mean = {r.user_id for r in cleaning.clean(df, id_policy="mean").collect()}
    assert drop == {1, 3, None} and mean == {1, 2, 3}
    with pytest.raises(ValueError):
        cleaning.fit_cleaning(df, id_policy="other")


def test_whole_numbers_beyond_64_bits_become_text(spark):
    df = spark.sql("SELECT CAST('99999999999999999999' AS DECIMAL(20,0)) AS imsi, "
                   "CAST(7 AS DECIMAL(20,0)) AS imei, CAST(5 AS INT) AS n, 1.5D AS x")
    out = cleaning.safe_integers(df)
    assert dict(out.dtypes) == {"imsi": "string", "imei": "bigint", "n": "bigint", "x": "double"}
    assert out.first().imsi == "99999999999999999999"


def test_names_are_stripped(spark):
    assert cleaning.strip_names(spark.range(1).toDF("  id ")).columns == ["id"]


def test_approximate_mode_runs(spark, raw):
    df = to_spark(spark, raw)
    approx = cleaning.fit_cleaning(df, quantile_mode="approx")
    exact = cleaning.fit_cleaning(df)
    assert approx.fences[MEASURE].high == pytest.approx(exact.fences[MEASURE].high, rel=0.05)
