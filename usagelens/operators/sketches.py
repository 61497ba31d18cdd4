"""Key figures per day in a form that can be added up, distinct counts as HyperLogLog sketches.

A day's row holds its numbers of records and bytes and a sketch of its users and of its handset
types.  Figures of any set of days come from these rows alone: sketches are united, which
gives the sketch of all their sessions, not a sum of distinct counts.  The relative standard
error of an estimate is ``1.04 / sqrt(2 ^ LG)``.  Sessions without a start are the day null; null users
and handsets do not count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from usagelens.schema import DEFAULT, SessionSchema

#: Binary logarithm of the sketches' registers.
LG = 14
ERROR = 1.04 / math.sqrt(2 ** LG)


def daily_figures(df: DataFrame, schema: SessionSchema = DEFAULT, lg: int = LG) -> DataFrame:
    """``day, records, dl, ul, users, handsets``; the last two are sketches."""
    return df.groupBy(F.to_date(schema.order).alias("day")).agg(
        F.count("*").alias("records"), F.sum(schema.total_downlink).alias("dl"),
        F.sum(schema.total_uplink).alias("ul"),
        F.hll_sketch_agg(F.col(schema.user).cast("long"), lg).alias("users"),
        F.hll_sketch_agg(schema.handset, lg).alias("handsets"))


def united(days: DataFrame) -> DataFrame:
    """One row for all the days, or for those of several tables of days."""
    return days.agg(F.sum("records").alias("records"), F.sum("dl").alias("dl"), F.sum("ul").alias("ul"),
                    F.hll_union_agg("users").alias("users"),
                    F.hll_union_agg("handsets").alias("handsets"))


def banner(days: DataFrame) -> DataFrame:
    """Records, estimated distinct users and handset types, volume per direction in TB."""
    return united(days).select(
        F.col("records").alias("total_records"),
        F.hll_sketch_estimate("users").alias("unique_users"),
        F.hll_sketch_estimate("handsets").alias("handset_types"),
        (F.col("dl") / 1e12).alias("total_dl_tb"), (F.col("ul") / 1e12).alias("total_ul_tb"))
