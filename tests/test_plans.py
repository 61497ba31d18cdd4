"""Physical plans: no Python workers, pruned scans, limits below the shuffle."""

import re

import pytest

from session_helpers import TESTDATA, plan_text
from usagelens.operators import cleaning, features, ranking, segments, statistics
from usagelens.sources.warehouse import session_view

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def view(spark):
    return session_view(spark, str(TESTDATA))


def test_no_python_in_any_operator(view):
    ov = features.user_overview(view)
    for df in (cleaning.clean(view), ov, features.user_features(view),
               segments.decile_segmentation(ov), statistics.basic_metrics(view),
               statistics.histogram(view, ["dur_ms"]), ranking.top_engaged(features.user_engagement(view))):
        assert not re.search("Python|Pandas|Arrow", plan_text(df))


def test_scan_reads_only_needed_columns(view):
    schemas = " ".join(re.findall(r"ReadSchema: (\S+)", plan_text(features.user_engagement(view))))
    assert "l_extendedprice" in schemas and "o_custkey" in schemas
    assert "l_tax" not in schemas and "p_name" not in schemas and "o_totalprice" not in schemas


def test_sessions_meet_only_hash_aggregates(view):
    for df in (features.user_features(view), features.user_overview(view),
               features.user_last_handset(view), features.user_experience(view)):
        text = plan_text(df)
        over_sessions = text[text.index("hashpartitioning(user_id"):]  # the lowest exchange by user
        below = text[text.rindex("hashpartitioning(user_id"):]
        assert "HashAggregate" in below
        assert "SortAggregate" not in below and "ObjectHashAggregate" not in below
        assert over_sessions.count("hashpartitioning(user_id") == 2


def test_top_n_limits_before_shuffling(view):
    per_metric = plan_text(ranking.top_engaged(features.user_engagement(view)))
    assert re.search(r"WindowGroupLimit.*Partial", per_metric)
    assert "TakeOrderedAndProject" in plan_text(ranking.top_handsets(view))


def test_deciles_rank_nothing(view):
    text = plan_text(segments.with_decile(features.user_overview(view)))
    assert "Window" not in text and "Sort [total_duration" not in text


def test_cleaning_is_a_projection(view):
    text = plan_text(cleaning.clean(view))
    assert "Aggregate" not in text and "Window" not in text


def test_unwindowed_partitions_only_hold_cluster_rows(view):
    """Windows over everything appear above aggregates of a few rows only."""
    text = plan_text(ranking.market_share(view))
    single = text.index("Window")
    assert "TakeOrderedAndProject" in text[single:]
