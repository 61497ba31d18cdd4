"""Shared session and fixtures."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from usagelens.operators import features  # noqa: E402
from usagelens.operators.cleaning import clean  # noqa: E402
from usagelens.schema import APPLICATIONS  # noqa: E402
from session_helpers import to_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def raw_frame(n=400, users=60, seed=7) -> pd.DataFrame:
    """Sessions with repeat users, ties, missing numbers, texts and users."""
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "bearer_id": rng.integers(1, 10_000, n),
        "user_id": rng.integers(0, users, n).astype(float),
        "start_ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 500, n), "h"),
        "dur_ms": rng.integers(1, 60, n) * 60_000.0,
        "handset_manufacturer": rng.choice(["Ares", "Boreas", "Ceres"], n),
        "handset_type": rng.choice(["a1", "b2", "c3", "d4"], n),
        "rtt_dl_ms": rng.uniform(5, 200, n), "rtt_ul_ms": rng.uniform(5, 90, n),
        "tp_dl_kbps": rng.lognormal(6, 1.5, n), "tp_ul_kbps": rng.lognormal(4, 1.5, n),
        "tcp_dl_bytes": rng.exponential(1e5, n), "tcp_ul_bytes": rng.exponential(1e4, n)})
    for i, a in enumerate(APPLICATIONS):
        df[a.downlink] = rng.uniform(0, (i + 1) * 1e6, n).round(2)
        df[a.uplink] = rng.uniform(0, (i + 1) * 1e5, n).round(2)
    df["total_dl"] = rng.uniform(1e6, 5e8, n).round(2)
    df["total_ul"] = rng.uniform(1e5, 5e7, n).round(2)
    for c, share in (("rtt_dl_ms", 0.1), ("tcp_dl_bytes", 0.1), ("handset_type", 0.08),
                     ("handset_manufacturer", 0.05), ("user_id", 0.02)):
        df.loc[rng.random(n) < share, c] = None
    # one user holds a third of all sessions
    df.loc[rng.random(n) < 0.33, "user_id"] = 3.0
    return df


@pytest.fixture(scope="session")
def raw() -> pd.DataFrame:
    return raw_frame()


@pytest.fixture(scope="session")
def sessions(spark, raw):
    df = to_spark(spark, raw).repartition(4).persist()
    assert df.count() == len(raw)
    return df


@pytest.fixture(scope="session")
def cleaned(sessions):
    return clean(sessions).persist()


@pytest.fixture(scope="session")
def users(cleaned):
    return features.user_features(cleaned).persist()
