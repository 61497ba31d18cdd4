"""Per-user feature tables.

Sums, counts and means come from ``groupBy(user)`` with algebraic hash aggregates: map-side
partial aggregation reduces a user holding a third of all sessions to one row per task before
the shuffle.  Handset look-ups (last seen, most frequent) need text, which hash aggregates
cannot hold.  Tables with a handset are therefore summed per (user, handset) first, again
with plain hash aggregates over numbers, and the few rows per user that remain are combined
in a second, small aggregate.  :func:`user_features` builds every table's columns in a single
pass; the single-table functions ask for fewer columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from usagelens.operators.cleaning import UNKNOWN
from usagelens.schema import DEFAULT, SessionSchema, require


#: Whether a session goes in for its measures or for its handset.
MEASURED = "goes in for measures"


@dataclass(frozen=True)
class _Measure:
    """An aggregate in two steps: over sessions, then over what those gave."""

    name: str
    kind: str
    value: Column

    def first(self, where: Column | None = None) -> list[Column]:
        value = self.value if where is None else F.when(where, self.value)
        if self.kind == "count":
            return [F.count(value).alias(self.name)]
        total = F.sum(value).alias(self.name)
        return [total, F.count(value).alias(f"{self.name} n")] if self.kind == "mean" else [total]

    def second(self) -> Column:
        total = F.sum(f"`{self.name}`")
        if self.kind == "mean":
            total = F.try_divide(total, F.sum(f"`{self.name} n`"))
        return total.alias(self.name)

    def single(self) -> Column:
        kinds = {"count": F.count, "sum": F.sum, "mean": F.avg}
        return kinds[self.kind](self.value).alias(self.name)


def _per_handset(known: DataFrame, schema: SessionSchema, measures: Sequence[_Measure],
                 handsets: Sequence[str], inner: Sequence[Column]) -> DataFrame:
    """Rows per (user, handset) with the columns ``inner``; the measures are in the user's row
    without a handset."""
    turns = F.array(*[F.lit(measured) for measured in ([True, False] if measures else [False])])
    return known.withColumn(MEASURED, F.explode(turns)).groupBy(
        schema.user, *[F.when(~F.col(MEASURED), F.col(h)).alias(h) for h in handsets]).agg(
        *[c for m in measures for c in m.first(F.col(MEASURED))], *inner)


def _per_user(df: DataFrame, schema: SessionSchema, measures: Sequence[_Measure],
              handsets: Sequence[str] = (), looks: Sequence[Column] = (),
              inner: Sequence[Column] = ()) -> DataFrame:
    """Measures per user; with handsets also ``looks`` over rows per (user, handset), which
    hold the columns ``inner``; they leave out rows without a handset."""
    require(df, [schema.user], "per-user features")
    known = df.where(F.col(schema.user).isNotNull())
    if not handsets:
        return known.groupBy(schema.user).agg(*[m.single() for m in measures])
    return _per_handset(known, schema, measures, handsets, inner).groupBy(schema.user).agg(
        *[m.second() for m in measures], *looks)


def _volume_sums(schema: SessionSchema) -> list[_Measure]:
    return [_Measure("total_duration_ms", "sum", F.col(schema.duration)),
            _Measure("total_dl_bytes", "sum", F.col(schema.total_downlink)),
            _Measure("total_ul_bytes", "sum", F.col(schema.total_uplink))]


def _total(df: DataFrame, schema: SessionSchema) -> Column:
    if schema.total in df.columns:
        return F.col(schema.total)
    return F.col(schema.total_downlink) + F.col(schema.total_uplink)


_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
SEEN, TIMES = "last seen", "times seen"


def _seen_key(df: DataFrame, schema: SessionSchema) -> Column:
    """Time and bearer id packed into one number, which a hash aggregate can take the maximum of.

    A missing time or bearer counts as the smallest.
    """
    def digits(c: str, kind: type | None) -> Column:
        value = F.unix_micros(F.col(c).cast("timestamp")) if isinstance(kind, _TIMES) else F.col(c)
        return F.expr("cast(0 as decimal(38,0))") + F.coalesce(
            value.cast("decimal(20,0)"), F.lit(-10 ** 17).cast("decimal(20,0)"))

    types = {f.name: f.dataType for f in df.schema.fields}
    key = digits(schema.order, types[schema.order]) if schema.order in types else F.expr(
        "cast(0 as decimal(38,0))")
    if isinstance(types.get("bearer_id"), (T.IntegralType, T.DecimalType)):
        key = key * F.expr("cast('100000000000000000000' as decimal(38,0))") + digits(
            "bearer_id", None)
    return key.cast("decimal(38,0)")


def _last_seen(column: str, handsets: Sequence[str]) -> Column:
    """Last non-null value in time order; equal times fall to the larger name."""
    return F.max(F.when(F.col(column).isNotNull(), F.struct(f"`{SEEN}`", *handsets)))[column].alias(column)


def _modal_handset(schema: SessionSchema) -> Column:
    """Most frequent handset, smallest name on a tie, over rows per (user, handset)."""
    handset = F.col(schema.handset)
    best = F.min(F.when(handset.isNotNull(), F.struct(-F.col(f"`{TIMES}`"), handset)))
    return F.coalesce(best[schema.handset], F.lit(UNKNOWN)).alias(schema.handset)


def _app_totals(df: DataFrame, schema: SessionSchema) -> list[_Measure]:
    """Per application: downlink plus uplink, a missing volume counting as zero."""
    out = []
    for app, columns in schema.present_apps(df):
        cell = F.coalesce(F.col(columns[0]), F.lit(0.0))
        for c in columns[1:]:
            cell = cell + F.coalesce(F.col(c), F.lit(0.0))
        out.append(_Measure(app.total, "sum", cell))
    return out


def _quality_means(df: DataFrame, schema: SessionSchema) -> list[_Measure]:
    return [_Measure(name, "mean", F.col(c))
            for m in schema.quality
            for c, name in ((m.downlink, m.downlink_mean), (m.uplink, m.uplink_mean))
            if c in df.columns]


def _combined_quality(df: DataFrame, schema: SessionSchema) -> dict[str, Column]:
    """Half the sum of both directions; a direction the table lacks counts zero."""
    def side(c: str, name: str) -> Column:
        return F.col(name) if c in df.columns else F.lit(0.0)
    return {m.combined: (side(m.downlink, m.downlink_mean)
                         + side(m.uplink, m.uplink_mean)) / 2 for m in schema.quality}


def user_overview(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Sessions, duration, volumes, per-direction application sums, last handset."""
    handsets = [c for c in (schema.manufacturer, schema.handset) if c in df.columns]
    measures = [_Measure("sessions_count", "count", F.col(schema.duration)),
                *_volume_sums(schema), _Measure("total_data_bytes", "sum", _total(df, schema)),
                *[_Measure(f"{c}_sum", "sum", F.col(c)) for c in schema.app_columns(df)]]
    return _per_user(df, schema, measures, handsets, [_last_seen(c, handsets) for c in handsets],
                     [F.max(_seen_key(df, schema)).alias(SEEN)])


def user_last_handset(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Manufacturer and type last seen per user, each the last non-null one."""
    handsets = [schema.manufacturer, schema.handset]
    return _per_user(df, schema, [], handsets, [_last_seen(c, handsets) for c in handsets],
                     [F.max(_seen_key(df, schema)).alias(SEEN)])


def user_modal_handset(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    return _per_user(df, schema, [], [schema.handset], [_modal_handset(schema)],
                     [F.count("*").alias(TIMES)])


def user_engagement(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Session count, duration and traffic per user."""
    sums = _per_user(df, schema, [_Measure("sessions_frequency", "count", F.col(schema.duration)),
                                  *_volume_sums(schema)])
    return sums.withColumn("total_traffic_bytes",
                           F.col("total_dl_bytes") + F.col("total_ul_bytes"))


def user_app_traffic(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Total bytes per user and application."""
    return _per_user(df, schema, _app_totals(df, schema))


def user_experience(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Mean service quality per user and the most frequent handset."""
    measures = _quality_means(df, schema)
    if schema.handset in df.columns:
        means = _per_user(df, schema, measures, [schema.handset], [_modal_handset(schema)],
                          [F.count("*").alias(TIMES)])
    else:
        means = _per_user(df, schema, measures)
    return means.withColumns(_combined_quality(df, schema))


PARTS = ("engagement", "traffic", "experience")


def part_inputs(df: DataFrame, schema: SessionSchema, parts: Sequence[str] = PARTS) -> list[str]:
    """Session columns that the named parts of :func:`user_features` read."""
    wanted = {
        "engagement": [schema.duration, schema.total_downlink, schema.total_uplink],
        "traffic": list(schema.app_columns(df)),
        "experience": [c for m in schema.quality for c in (m.downlink, m.uplink)]
        + [schema.handset]}
    needed = {schema.user}.union(*[wanted[p] for p in parts])
    return [c for c in df.columns if c in needed]


def user_features(df: DataFrame, schema: SessionSchema = DEFAULT,
                  parts: Sequence[str] = PARTS) -> DataFrame:
    """Engagement, application and experience features in one pass over the sessions.

    The columns equal those of the single-table functions above.
    """
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown feature part(s): {', '.join(sorted(unknown))}")
    measures, derived = [], {}
    if "engagement" in parts:
        measures += [_Measure("sessions_frequency", "count", F.col(schema.duration)),
                     *_volume_sums(schema)]
        derived["total_traffic_bytes"] = F.col("total_dl_bytes") + F.col("total_ul_bytes")
    if "traffic" in parts:
        measures += _app_totals(df, schema)
    if "experience" in parts:
        measures += _quality_means(df, schema)
        derived |= _combined_quality(df, schema)
    if "experience" in parts and schema.handset in df.columns:
        users = _per_user(df, schema, measures, [schema.handset], [_modal_handset(schema)],
                          [F.count("*").alias(TIMES)])
    else:
        users = _per_user(df, schema, measures)
    return users.withColumns(derived)
