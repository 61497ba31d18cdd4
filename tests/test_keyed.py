"""Quantiles of many keys against numpy."""

import numpy as np
import pandas as pd
import pytest

from usagelens.functions.keyed import keyed_quantiles
from usagelens.operators import statistics

FRACTIONS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def awkward(seed=3):
    rng = np.random.default_rng(seed)
    groups = {"hot": np.concatenate([rng.lognormal(0, 3, 4000), np.full(2000, 42.0)]),
              "one": np.array([7.5]), "two": np.array([-1.0, 1e-300]), "same": np.full(50, -3.25),
              "signs": rng.normal(0, 1, 501) * 10.0 ** rng.integers(-200, 200, 501),
              "close": 1e6 + np.arange(1000) * 1e-9, "ends": np.array([-1e308, -5e-324, 0.0, 5e-324, 1e308])}
    groups |= {f"k{i}": rng.normal(i, 1, rng.integers(1, 8)).round(2) for i in range(400)}
    return groups


def test_quantiles_of_many_keys_equal_numpy(spark):
    groups = awkward()
    rows = pd.DataFrame([(k, float(v)) for k, x in groups.items() for v in x], columns=["k", "v"])
    long = spark.createDataFrame(rows).repartition(6)
    more = spark.createDataFrame([("k1", None), (None, 3.0), ("gone", None)], "k string, v double")
    found = {r.k: r for r in keyed_quantiles(long.union(more), FRACTIONS, "k", "v").collect()}
    assert found.keys() == groups.keys()
    for k, x in groups.items():
        x = np.sort(x)
        assert (found[k].n, found[k].low, found[k].high) == (len(x), x[0], x[-1])
        for j, p in enumerate(FRACTIONS):
            spot = p * (len(x) - 1)
            a, b = x[int(np.floor(spot))], x[int(np.ceil(spot))]
            assert found[k][f"q{j}"] == pytest.approx(a + (b - a) * (spot - np.floor(spot)), rel=1e-12, abs=0)


def test_no_rows(spark):
    assert keyed_quantiles(spark.createDataFrame([], "k string, v double"), (0.5,), "k", "v").count() == 0


def test_boxes_of_many_groups_equal_those_of_few(spark):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"g": rng.integers(0, 12, 900), "value": rng.standard_t(2, 900).round(3)})
    long = spark.createDataFrame(rows).repartition(3)

    def plain(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert plain(statistics.keyed_box_statistics(long, "g")) == plain(statistics.box_statistics(long, "g"))
