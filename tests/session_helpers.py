"""Helpers that test modules import by name; fixtures are in conftest.py."""

from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from usagelens.sources.files import nan_to_null

TESTDATA = Path("/root/testdata/sf0.001")


def to_spark(spark, pdf: pd.DataFrame):
    """NaN and NaT become null; the user is a whole number."""
    df = nan_to_null(spark.createDataFrame(pdf))
    if "user_id" in df.columns:
        df = df.withColumn("user_id", F.col("user_id").cast("long"))
    for c in ("handset_type", "handset_manufacturer"):
        if c in df.columns:
            df = df.withColumn(c, F.when(F.col(c) != "NaN", F.col(c)))
    return df


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
