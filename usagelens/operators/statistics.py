"""Descriptive statistics over many columns, on the long form."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.keyed import keyed_quantiles
from usagelens.functions.long import to_long
from usagelens.functions.moments import sample_excess_kurtosis, sample_skewness
from usagelens.functions.orderstats import RankPolicy, quantiles
from usagelens.schema import DEFAULT, SessionSchema
from usagelens.workspace import materialise


BROADCAST_ROWS = 100_000


def small_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-built table (one row per column or group).

    Broadcast in joins while its row count allows; beyond that Spark picks the join.
    """
    table = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _with_quantiles(stats: DataFrame, long: DataFrame, names: Sequence[str],
                    fractions: Sequence[float], mode: str, policy: RankPolicy) -> DataFrame:
    known = quantiles(long, fractions, mode, policy=policy)
    schema = "variable string, " + ", ".join(f"`{n}` double" for n in names)
    table = small_table(stats, [(v, *q) for v, q in known.items()], schema)
    return stats.join(table, "variable", "left")


def summarize(df: DataFrame, schema: SessionSchema = DEFAULT, quantile_mode: str = "exact",
              policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Count, mean, std, min, quartiles and max of every numeric column."""
    long = to_long(df, schema.numeric(df), drop_null=False)
    stats = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    return (_with_quantiles(stats, long, ["q25", "q50", "q75"], (0.25, 0.5, 0.75),
                            quantile_mode, policy)
            .select("variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def column_types(df: DataFrame) -> DataFrame:
    return small_table(df, [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                       "variable string, dtype string")


def describe_variables(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Type of every column, with mean, std, min and max of the numeric ones."""
    stats = to_long(df, schema.numeric(df)).groupBy("variable").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return column_types(df).join(stats, "variable", "left")


_WAYS = {"dl": "downlink", "ul": "uplink"}
_QUALITY_TEXT = {"rtt": "round-trip time in milliseconds", "tp": "throughput in kbit/s",
                 "tcp": "TCP retransmissions in bytes"}
_OWN_TEXT = {"bearer_id": "session", "user_id": "user", "imsi": "subscriber card",
             "imei": "device"}


def field_meanings(schema: SessionSchema = DEFAULT) -> list[tuple[str, str, str]]:
    """Name, kind and description of every column a session record can have, by its role."""
    rows = [(c, "identifier", f"identifier of the {what}") for c, what in _OWN_TEXT.items()]
    for end in ("start", "end"):
        rows += [(f"{end}_ts", "time", f"{end} of the session"),
                 (f"{end}_ms", "time", f"{end} of the session, millisecond part")]
    rows += [(schema.duration, "measure", "duration of the session in milliseconds"),
             (schema.manufacturer, "category", "maker of the handset"),
             (schema.handset, "category", "model of the handset")]
    for metric in schema.quality:
        text = _QUALITY_TEXT[metric.downlink.split("_")[0]]
        rows += [(c, "measure", f"{way} {text}") for c, way in
                 zip((metric.downlink, metric.uplink), _WAYS.values())]
    rows += [(c, "measure", f"{app.title} {way} volume in bytes") for app in schema.applications
             for c, way in zip(app.columns, _WAYS.values())]
    return rows + [(schema.total_downlink, "measure", "total downlink volume in bytes"),
                   (schema.total_uplink, "measure", "total uplink volume in bytes"),
                   (schema.total, "measure", "total volume of both directions in bytes")]


def field_dictionary(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Meaning of each column together with its type and fill level in ``df``.

    Columns that ``df`` lacks have no type; columns without a known meaning have no text.
    """
    meanings = small_table(df, field_meanings(schema),
                           "variable string, kind string, description string")
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]) \
               .unpivot([], df.columns, "variable", "filled")
    held = column_types(df).join(filled, "variable")
    return (meanings.join(held, "variable", "full")
            .select("variable", "kind", "description", "dtype", "filled"))


def basic_metrics(df: DataFrame, schema: SessionSchema = DEFAULT, quantile_mode: str = "exact",
                  policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Mean, median, std, variance, skewness, kurtosis and missing cells, ids skipped."""
    long = to_long(df, schema.numeric(df, skip_ids=True), drop_null=False)
    stats = long.groupBy("variable").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.var_samp("value").alias("variance"),
        sample_skewness("value").alias("skewness"),
        sample_excess_kurtosis("value").alias("kurtosis"),
        (F.count("*") - F.count("value")).alias("missing"))
    return (_with_quantiles(stats, long, ["median"], (0.5,), quantile_mode, policy)
            .select("variable", "mean", "median", "std", "variance", "skewness",
                    "kurtosis", "missing"))


def dispersion(df: DataFrame, schema: SessionSchema = DEFAULT, quantile_mode: str = "exact",
               policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Quartiles, their distance, range and coefficient of variation in percent."""
    long = to_long(df, schema.numeric(df))
    stats = long.groupBy("variable").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        (F.max("value") - F.min("value")).alias("range"))
    return (_with_quantiles(stats, long, ["q1", "q3"], (0.25, 0.75), quantile_mode, policy)
            .select("variable", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "range",
                    F.bround(F.col("std") / F.nullif("mean", F.lit(0.0)) * 100, 2)
                     .alias("cv_pct")))


# -- correlation -------------------------------------------------------------

def app_total_correlation(df: DataFrame, schema: SessionSchema = DEFAULT) -> DataFrame:
    """Pearson correlation of each application's volume with the total volume."""
    pairs = [F.struct(F.lit(app.key).alias("application"),
                      app_volume(columns).alias("x"), total_volume(df, schema).alias("y"))
             for app, columns in schema.present_apps(df)]
    return (df.select(F.inline(F.array(*pairs))).groupBy("application")
            .agg(F.round(F.corr("x", "y"), 4).alias("correlation"))
            .orderBy(F.desc("correlation"), F.asc("application")))


def app_volume(columns: Sequence[str]) -> Column:
    """Sum of the directions of one application, a missing one counting zero."""
    cell = F.coalesce(F.col(columns[0]), F.lit(0.0))
    for c in columns[1:]:
        cell = cell + F.coalesce(F.col(c), F.lit(0.0))
    return cell


def total_volume(df: DataFrame, schema: SessionSchema) -> Column:
    return F.col(schema.total_downlink) + F.col(schema.total_uplink)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise Pearson correlations as ``(col_a, col_b, r)`` rows.

    Complete tables (as left by cleaning) go through the vectorised Gram-matrix
    computation; with nulls each pair uses the rows where both sides are present.
    Either way one row per pair is all that leaves the executors.
    """
    columns = list(columns)
    gaps = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    if any(gaps[c] < gaps.n for c in columns) or gaps.n < 2:
        return _pairwise_correlation(df, columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(df).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    rows = [(a, b, None if matrix[i, j] != matrix[i, j] else float(matrix[i, j]))
            for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")


def _pairwise_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, a) for a in columns] + list(combinations(columns, 2))
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"),
                               F.col(b).cast("double").alias("y"))
                      for i, (a, b) in enumerate(pairs)])
    names = small_table(df, [(i, a, b) for i, (a, b) in enumerate(pairs)],
                        "pair int, col_a string, col_b string")
    half = (df.select(F.inline(cells)).groupBy("pair").agg(F.corr("x", "y").alias("r"))
            .join(names, "pair").select("col_a", "col_b", "r"))
    both = F.array(F.struct("col_a", "col_b", "r"),
                   F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r"))
    own = F.array(F.struct("col_a", "col_b", "r"))
    return half.select(F.inline(F.when(F.col("col_a") == F.col("col_b"), own).otherwise(both)))


def app_correlation_matrix(sessions: DataFrame, traffic: DataFrame | None = None,
                           schema: SessionSchema = DEFAULT, level: str = "session") -> DataFrame:
    """Correlation of application volumes, per session and direction or per user."""
    if level == "session":
        return correlation_matrix(sessions, schema.app_columns(sessions))
    if level == "user":
        return correlation_matrix(traffic, [a.total for a in schema.applications
                                            if a.total in traffic.columns])
    raise ValueError(f"unknown level {level!r}")


# -- binned views of distributions -------------------------------------------

def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin number, the last bin closed; a constant gets width one."""
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low)
    return F.least(F.floor((value - start) / width * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50,
              by: str | None = None) -> DataFrame:
    """Equal-width histograms of several columns, optionally per group.

    All groups of a column share its bins.  Empty bins are kept with count zero.
    """
    keep = [by] if by else []
    long = to_long(df, [c for c in columns if c in df.columns], keep=keep)
    ranges = F.broadcast(long.groupBy("variable").agg(  # one row per column
        F.min("value").alias("low"), F.max("value").alias("high")))
    counts = (long.join(ranges, "variable")
              .groupBy("variable", *keep,
                       _bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"))
              .agg(F.count("*").alias("count")))
    low, high = F.col("low"), F.col("high")
    start = F.when(low == high, low - 0.5).otherwise(low)
    width = F.when(low == high, F.lit(1.0)).otherwise(high - low) / bins
    frame = ranges.select("variable", start.alias("start"), width.alias("width"),
                          F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    if by:
        frame = frame.join(counts.select("variable", by).distinct(), "variable")
    found = counts.select(F.col("variable").alias("_variable"), F.col("bin").alias("_bin"),
                          "count", *[F.col(c).alias("_group") for c in keep])
    same = (F.col("variable") == F.col("_variable")) & (F.col("bin") == F.col("_bin"))
    if by:
        same = same & F.col(by).eqNullSafe(F.col("_group"))
    edge = F.col("start") + F.col("bin") * F.col("width")
    return frame.join(found, same, "left").select(
        "variable", *keep, "bin", edge.alias("bin_start"),
        (edge + F.col("width")).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"))


def grid_counts(points: DataFrame, bins: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """Two-dimensional bin counts of ``(variable, x, y)`` points: a scatter plot's data."""
    known = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranges = F.broadcast(known.groupBy("variable").agg(  # one row per plot
        F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1")))
    return (known.join(ranges, "variable")
            .groupBy("variable", *keep,
                     _bin(F.col("x"), F.col("x0"), F.col("x1"), bins).alias("x_bin"),
                     _bin(F.col("y"), F.col("y0"), F.col("y1"), bins).alias("y_bin"))
            .agg(F.count("*").alias("count")))


def app_total_grid(df: DataFrame, schema: SessionSchema = DEFAULT, bins: int = 20) -> DataFrame:
    """Application volume against total volume in MB, as bin counts per application."""
    points = [F.struct(F.lit(app.key).alias("variable"),
                       (app_volume(columns) / 1e6).alias("x"),
                       (total_volume(df, schema) / 1e6).alias("y"))
              for app, columns in schema.present_apps(df)]
    return (grid_counts(df.select(F.inline(F.array(*points))), bins)
            .withColumnRenamed("variable", "application"))


def box_statistics(long: DataFrame, group: str, value: str = "value",
                   policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Five-number summary per group with 1.5-IQR whiskers, mean and outlier count."""
    known = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    quartiles = quantiles(known, (0.25, 0.5, 0.75), key=group, value=value, policy=policy)
    dtype = long.schema[group].dataType.simpleString()
    boxes = small_table(known, [(g, *q) for g, q in quartiles.items()],
                        f"`{group}` {dtype}, q1 double, median double, q3 double")
    return _boxed(known, boxes, group, value)


def _boxed(known: DataFrame, boxes: DataFrame, group: str, value: str) -> DataFrame:
    """Counts, ends and whiskers per group from its quartiles."""
    v = F.col(value)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return (known.join(boxes, group).groupBy(group, "q1", "median", "q3")
            .agg(F.count("*").alias("count"), F.avg(v).alias("mean"),
                 F.min(v).alias("min"), F.max(v).alias("max"),
                 F.min(F.when(inside, v)).alias("whisker_low"),
                 F.max(F.when(inside, v)).alias("whisker_high"),
                 F.count(F.when(~inside, 1)).alias("outliers"))
            .select(group, "count", "mean", "min", "whisker_low", "q1", "median", "q3",
                    "whisker_high", "max", "outliers"))


def keyed_box_statistics(long: DataFrame, group: str, value: str = "value") -> DataFrame:
    """:func:`box_statistics` for any number of groups: quartiles are found and joined as a table."""
    known = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    boxes = keyed_quantiles(known, (0.25, 0.5, 0.75), group, value).select(
        group, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    return _boxed(known, materialise(boxes, "boxes"), group, value)


def app_box_statistics(df: DataFrame, schema: SessionSchema = DEFAULT,
                       policy: RankPolicy = RankPolicy()) -> DataFrame:
    """Box statistics of the downlink volume of every application."""
    columns = {a.key: F.col(a.downlink) for a in schema.applications
               if a.downlink in df.columns}
    return box_statistics(to_long(df, columns, variable="application"), "application",
                          policy=policy)
