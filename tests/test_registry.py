"""A sample of the registered queries against their SQL twins, and the contract."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.queries import REGISTRY
from session_helpers import TESTDATA

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")

SAMPLE = ["load_sessions", "outlier_iqr_replace", "safe_int_cast", "user_overview",
          "user_experience", "top_handsets_per_manufacturer", "histogram_by_group",
          "app_total_correlation", "decile_segmentation", "correlation_matrix",
          "correlation_with_gaps", "app_boxplot_stats", "top10_per_app", "engagement_clusters",
          "experience_extremes", "train_ridge", "pca_loadings", "experience_restarts", "gbt_nodes",
          "gbt_cv_small", "load_sessions_csv", "field_descriptions", "incremental_features"]


@pytest.fixture(scope="module")
def duck():
    return connect(str(TESTDATA))


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_and_sql_agree(spark, duck, name):
    assert compare(spark, duck, name, str(TESTDATA)) is None


def test_contract_functions(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(REGISTRY) <= set(contract.queries())
    assert contract.entry(spark).count() == 3


def test_every_sql_text_parses(duck):
    for name, text in contract.oracle_sql().items():
        duck.execute("EXPLAIN " + text)
