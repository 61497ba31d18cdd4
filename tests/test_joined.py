"""Reading the session view several times joins once; stored tables are small."""

import hashlib
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.queries import REGISTRY, _written_sessions
from checks.session import cleaned_sessions, joined_once
from session_helpers import plan_text
from usagelens.operators.cleaning import clean
from usagelens.sources import files
from usagelens.sources.files import Manifest
from usagelens.sources.warehouse import joined_rows, session_view
from usagelens.workspace import SHUFFLE_CLEANUP, materialise, shared_root


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    """A warehouse with a repeated part, a null and an unmatched key."""
    at, rng, n = str(tmp_path_factory.mktemp("warehouse-files")), np.random.default_rng(4), 400
    line = pd.DataFrame({"l_orderkey": rng.integers(1, 80, n), "l_partkey": rng.integers(1, 33, n),
                         "l_suppkey": rng.integers(1, 20, n), "l_linenumber": np.arange(n, dtype="i4"),
                         "l_quantity": rng.integers(1, 50, n) * 1.0,
                         "l_extendedprice": rng.uniform(1, 1e4, n).round(2),
                         "l_discount": rng.integers(0, 10, n) / 100, "l_tax": rng.integers(0, 8, n) / 100,
                         "l_returnflag": "N", "l_linestatus": "O",
                         "l_shipdate": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 99, n), "D")})
    orders = pd.DataFrame({"o_orderkey": np.arange(1, 75), "o_custkey": rng.integers(1, 15, 74)})
    part = pd.DataFrame({"p_partkey": [*range(1, 31), 7], "p_brand": "b", "p_name": [f"n{i}" for i in range(31)]})
    for name, pdf in (("lineitem", line), ("orders", orders), ("part", part)):
        df = spark.createDataFrame(pdf)
        if name == "lineitem":
            df = df.withColumn("l_partkey", F.when(F.col("l_linenumber") % 19 != 0, F.col("l_partkey")))
        df.write.parquet(f"{at}/{name}.parquet")
    return at


def rows(df):
    return sorted(map(str, df.collect()))


def rounded(df):
    return sorted([tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()])


def test_several_passes_join_once(spark, warehouse):
    view = joined_once(spark, warehouse)
    assert "Join" in plan_text(joined_rows(spark, warehouse)) and "Join" not in plan_text(view)
    assert rows(view) == rows(session_view(spark, warehouse))
    assert rows(joined_once(spark, warehouse)) == rows(view)
    for name in ("outlier_iqr_replace", "clean_sessions"):
        assert "Join" not in plan_text(REGISTRY[name].frame(spark, warehouse))
    assert cleaned_sessions(spark, warehouse).count() == view.count()


def test_stored_tables_are_packed(spark):
    table = materialise(spark.range(10), "packed")
    assert all(".zstd." in f for f in table.inputFiles())


def test_cleaned_sessions_are_no_second_copy(spark, warehouse):
    """What is stored is one row per learned number, and the cleaned rows come out the same."""
    got, view = cleaned_sessions(spark, warehouse), joined_once(spark, warehouse)
    name = hashlib.md5(warehouse.encode()).hexdigest()
    held = Manifest.read(spark, f"{shared_root(spark)}/cleaned-{name}")
    assert held.rows < 3 * len(view.columns) < view.count()
    assert got.schema.simpleString() == clean(view).schema.simpleString()
    assert rounded(got) == rounded(clean(view)) and rows(got) == rows(cleaned_sessions(spark, warehouse))
    assert cleaned_sessions(spark, warehouse).where("dur_ms IS NULL").isEmpty()


def test_written_csv_sessions_are_packed_in_bounded_files(spark, warehouse, monkeypatch):
    monkeypatch.setattr(files, "CSV_ROWS", 50)
    path, n = _written_sessions(spark, warehouse, "csv"), session_view(spark, warehouse).count()
    packed = spark.read.text(path).inputFiles()
    assert all(f.endswith(".csv.gz") for f in packed) and len(packed) >= n / 50
    found = files.read_sessions(spark, path, "csv", rejected="bad")
    assert found.count() == n and found.where("bearer_id % 7 = 0 AND NOT array_contains(bad, 'dur_ms')").isEmpty()


def test_shuffle_files_of_a_stored_table_go_with_its_write(spark, monkeypatch):
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])

    def shuffled():
        return {f for f in local.rglob("shuffle_*.data")}
    before, asked = shuffled(), spark.conf.get(SHUFFLE_CLEANUP, None)
    kept = materialise(spark.range(1000).repartition(3, "id"), "dealt")
    end = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < end:  # files are deleted in the background
        time.sleep(0.1)
    assert not shuffled() - before and kept.count() == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == asked


def test_roundtrip_stores_its_input_as_joined_rows(spark, warehouse):
    """The wide sessions are stored once, cleaned, and not also as the input."""
    got = REGISTRY["cleaned_roundtrip"].frame(spark, warehouse)
    stored = [p for p in Path(shared_root(spark).removeprefix("file:")).glob("sessions-*")]
    assert stored and all("l_orderkey" in spark.read.parquet(str(p)).columns for p in stored)
    assert got.count() == session_view(spark, warehouse).count()
