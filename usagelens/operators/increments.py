"""Per-user features kept up to date from batches of sessions.

The state holds one row per (user, manufacturer, handset) with everything the feature tables
need in a form that can be added up: sums, counts and the key of the last session.  A new batch
is reduced to such rows and added to the old state; old sessions are not read again.  Features
are read off the state and equal those of all batches together.

Every batch has a name.  The state is a ``StoredTable`` whose log has one entry per batch, written
with the version that includes it, so a batch that is added again, after a failure or by mistake,
changes nothing.  Sessions without a user are left out.  An empty batch is noted and adds no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.operators.features import (SEEN, TIMES, _app_totals, _combined_quality,
                                          _Measure, _modal_handset, _quality_means, _seen_key, _total,
                                          _volume_sums)
from usagelens.schema import DEFAULT, SessionSchema, require
from usagelens.sources.files import StoredTable


def _measures(df: DataFrame, schema: SessionSchema) -> list[_Measure]:
    return [_Measure("sessions_frequency", "count", F.col(schema.duration)), *_volume_sums(schema),
            _Measure("total_data_bytes", "sum", _total(df, schema)),
            *[_Measure(f"{c}_sum", "sum", F.col(c)) for c in schema.app_columns(df)],
            *_app_totals(df, schema), *_quality_means(df, schema)]


def session_state(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """The state that a batch of sessions gives."""
    require(df, [schema.user, schema.manufacturer, schema.handset], "incremental features")
    return df.where(F.col(schema.user).isNotNull()).groupBy(
        schema.user, schema.manufacturer, schema.handset).agg(
        *[c for m in _measures(df, schema) for c in m.first()],
        F.max(_seen_key(df, schema)).alias(SEEN), F.count("*").alias(TIMES))


def merged(states: list[DataFrame], schema: SessionSchema = DEFAULT) -> DataFrame:
    """The state of all batches from the states of some of them."""
    keys = [schema.user, schema.manufacturer, schema.handset]
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(*keys).agg(*[
        (F.max if c == SEEN else F.sum)(f"`{c}`").alias(c) for c in rows.columns if c not in keys])


def features_of(state: DataFrame, sample: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """All feature columns per user; ``sample`` is a session table with the batches' columns."""
    handsets = [schema.manufacturer, schema.handset]
    measures = _measures(sample, schema)
    parts = [c for c in state.columns if c not in (schema.user, *handsets, SEEN)]

    def last(c: str):
        return F.max(F.when(F.col(c).isNotNull(), F.struct(f"`{SEEN}`", *handsets))).alias(f"last {c}")

    per_handset = state.groupBy(schema.user, schema.handset).agg(
        *[F.sum(f"`{c}`").alias(c) for c in parts], *[last(c) for c in handsets])
    users = per_handset.groupBy(schema.user).agg(
        *[m.second() for m in measures], _modal_handset(schema).alias("modal_handset"),
        *[F.max(f"`last {c}`")[c].alias(f"last_{c}") for c in handsets])
    return users.withColumns({
        "total_traffic_bytes": F.col("total_dl_bytes") + F.col("total_ul_bytes"),
        **_combined_quality(sample, schema)})


class IncrementalFeatures:
    """The stored state below a path."""

    def __init__(self, spark: SparkSession, path: str, schema: SessionSchema = DEFAULT) -> None:
        self.table, self.schema = StoredTable(spark, path), schema

    def add(self, batch: str, sessions: DataFrame) -> bool:
        """Add a batch; whether it was new."""
        if batch in self.table.fingerprints():
            return False
        state, old = session_state(sessions, self.schema), self.table.current()
        self.table.replace(state if old is None else merged([old, state], self.schema), batch)
        return True

    def features(self, sample: DataFrame) -> DataFrame:
        state = self.table.current()
        if state is None:
            raise ValueError("no batch has been added")
        return features_of(state, sample, self.schema)
