import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from usagelens.operators import components, statistics
from usagelens.schema import DEFAULT


def numbers(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 200), "b": rng.exponential(4, 200),
                        "c": np.full(200, 2.5)})
    pdf.loc[:10, "b"] = np.nan
    df = spark.createDataFrame([(None if np.isnan(x.b) else float(x.b), float(x.a), float(x.c))
                                for x in pdf.itertuples()], "b double, a double, c double")
    return pdf, df.repartition(3)


def test_moments_match_pandas(spark):
    pdf, df = numbers(spark)
    got = {r.variable: r for r in statistics.basic_metrics(df).collect()}
    for c in pdf:
        assert got[c].mean == pytest.approx(pdf[c].mean())
        assert got[c].median == pytest.approx(pdf[c].median())
        assert got[c].variance == pytest.approx(pdf[c].var(), abs=1e-12)
        assert got[c].skewness == pytest.approx(pdf[c].skew(), abs=1e-9)
        assert got[c].kurtosis == pytest.approx(pdf[c].kurt(), abs=1e-9)
        assert got[c].missing == pdf[c].isna().sum()


def test_short_samples_have_no_higher_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    row = statistics.basic_metrics(df).first()
    assert row.skewness == pytest.approx(pd.Series([1.0, 2, 4]).skew()) and row.kurtosis is None
    assert statistics.basic_metrics(df.limit(2)).first().skewness is None


def test_summary_and_description_match_pandas(spark):
    pdf, df = numbers(spark)
    want = pdf.describe().T
    for r in statistics.summarize(df).collect():
        w = want.loc[r.variable]
        assert np.allclose([r["count"], r["mean"], r["std"], r["min"], r.q25, r.q50, r.q75, r["max"]],
                           w.values)
    described = {r.variable: r.dtype for r in statistics.describe_variables(
        df.withColumn("t", F.lit("x"))).collect()}
    assert described == {"a": "double", "b": "double", "c": "double", "t": "string"}


def test_dispersion(spark):
    pdf, df = numbers(spark)
    got = {r.variable: r for r in statistics.dispersion(df.withColumn("z", F.lit(0.0))).collect()}
    assert got["b"].iqr == pytest.approx(pdf.b.quantile(0.75) - pdf.b.quantile(0.25))
    assert got["b"].cv_pct == pytest.approx(round(pdf.b.std() / pdf.b.mean() * 100, 2))
    assert got["z"].cv_pct is None


@pytest.mark.parametrize("bins", [1, 7, 50])
def test_histogram_equals_numpy(spark, bins):
    pdf, df = numbers(spark)
    rows = statistics.histogram(df, ["a", "b", "c"], bins).orderBy("variable", "bin").collect()
    for c in pdf:
        want, edges = np.histogram(pdf[c].dropna(), bins)
        mine = [r for r in rows if r.variable == c]
        assert [r["count"] for r in mine] == list(want)
        assert np.allclose([r.bin_start for r in mine], edges[:-1])


def test_grouped_histogram_shares_bins(spark):
    df = spark.createDataFrame([("x", 0.0), ("x", 1.0), ("y", 10.0), (None, 5.0)],
                               "g string, v double")
    rows = statistics.histogram(df, ["v"], 10, by="g").collect()
    assert len(rows) == 30 and sum(r["count"] for r in rows) == 4
    assert {r.bin for r in rows if r.g == "y" and r["count"]} == {9}


def test_correlation_with_and_without_gaps(spark):
    pdf, df = numbers(spark)
    for columns, table in ((["a", "b"], df), (["a", "a2"], df.withColumn("a2", F.col("a") * -2))):
        source = pdf.assign(a2=pdf.a * -2)
        got = {(r.col_a, r.col_b): r.r for r in
               statistics.correlation_matrix(table, columns).collect()}
        want = source[columns].corr()
        assert len(got) == 4
        for (x, y), r in got.items():
            assert r == pytest.approx(want.loc[x, y])


def test_app_correlation_levels(cleaned, users):
    session = statistics.app_correlation_matrix(cleaned)
    user = statistics.app_correlation_matrix(cleaned, users, level="user")
    assert session.count() == 14 * 14 and user.count() == 7 * 7
    assert session.where("col_a = col_b AND abs(r - 1) > 1e-9").isEmpty()
    top = statistics.app_total_correlation(cleaned).collect()
    assert [r.correlation for r in top] == sorted([r.correlation for r in top], reverse=True)
    with pytest.raises(ValueError):
        statistics.app_correlation_matrix(cleaned, level="planet")


def test_box_statistics(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in values], "k string, value double")
    r = statistics.box_statistics(df, "k").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2, 3, 4, 1, 4, 1)


def test_field_dictionary_reads_the_table(sessions):
    rows = {r.variable: r for r in statistics.field_dictionary(sessions).collect()}
    assert rows["dur_ms"].filled == sessions.count()
    assert rows["handset_type"].filled < sessions.count()


def test_components_match_the_eigen_decomposition(cleaned):
    columns = DEFAULT.app_columns(cleaned)
    fit = components.fit_components(cleaned, columns, 2)
    matrix = np.array(cleaned.select(*columns).collect(), dtype=float)
    z = (matrix - matrix.mean(0)) / matrix.std(0)
    values, vectors = np.linalg.eigh(np.corrcoef(matrix.T))
    got = [r.explained_ratio for r in fit.explained(cleaned).collect()]
    assert np.allclose(got, values[::-1][:2] / 14)
    assert all(v >= 0 for v in got) and sum(got) <= 1
    loadings = np.array([list(r)[1:] for r in fit.loadings(cleaned).collect()])
    assert np.allclose(np.abs(loadings), np.abs(vectors[:, ::-1][:, :2]), atol=1e-6)
    assert all(col[np.abs(col).argmax()] > 0 for col in loadings.T)
    scores = np.array([list(r) for r in fit.scores(cleaned).collect()])
    assert np.allclose(np.sort(scores[:, 0]), np.sort(z @ loadings[:, 0]), atol=1e-6)


def test_more_components_than_columns(cleaned):
    assert components.fit_components(cleaned, ["google_dl", "google_ul"], 5).explained(
        cleaned).count() == 2
