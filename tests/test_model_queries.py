"""The registered model queries train and cross-validate every candidate."""

import pytest

from checks.queries import REGISTRY
from session_helpers import TESTDATA
from usagelens.operators import models

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="no test data")


@pytest.fixture
def few_trees(monkeypatch):
    monkeypatch.setitem(models.CANDIDATES, "gradient_boosting",
                        {**models.CANDIDATES["gradient_boosting"], "n_estimators": 2})
    monkeypatch.setitem(models.CANDIDATES, "random_forest",
                        {**models.CANDIDATES["random_forest"], "n_estimators": 2})


@pytest.mark.parametrize("name, trained", [
    ("train_gbt", ["gradient_boosting"]), ("train_rf", ["random_forest"]),
    ("model_comparison", sorted(models.CANDIDATES)), ("model_runs", sorted(models.CANDIDATES))])
def test_every_trained_model_is_cross_validated(spark, few_trees, name, trained):
    rows = REGISTRY[name].frame(spark, str(TESTDATA)).collect()
    assert sorted(r.model_name for r in rows) == trained
    assert all(r.cv_rmse is not None and r.cv_rmse > 0 for r in rows)


def test_the_forest_has_its_folds(spark, few_trees):
    rows = REGISTRY["rf_cv"].frame(spark, str(TESTDATA)).collect()
    assert sorted(r.fold for r in rows) == list(range(models.FOLDS))
