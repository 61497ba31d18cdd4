"""Registered queries: Spark side, SQL side, and the columns both must return.

Column lists are ``name``, ``name:int``, ``name:long``, ``name:text`` or
``name:<digits>`` (rounded with a nudge, see below), ``name:r<digits>`` (an operator
that rounds by itself) or ``name:s<digits>`` (significant digits).  The same list shapes both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import sql as S
from checks.session import cleaned_sessions, ensure_scratch, joined_once, stored_rows
from usagelens.functions.long import to_long
from usagelens.operators import (cleaning, clustering, components, features, models, ranking,
                                 reports, scoring, segments, sketches, statistics)
from usagelens.operators.increments import IncrementalFeatures
from usagelens.plans import job
from usagelens.plans.usage import UsagePlan
from usagelens.schema import DEFAULT, ENGAGEMENT_METRICS, EXPERIENCE_METRICS
from usagelens.sources import files, tables
from usagelens.sources.warehouse import read_table, session_user, session_view
from usagelens.workspace import materialise, scratch_path


def nudge(digits: str) -> float:
    """Part of a rounding unit added before rounding.

    Means of decimal values often end exactly on half a unit, where the last bit of
    a sum decides the rounded digit.  The shift moves such values off the edge and
    leaves values that already have few enough digits as they are.
    """
    return float(f"{2.718281828}e-{int(digits) + 1}")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    columns: str | None = None
    ctes: Sequence[str] = ()
    final: str | None = None

    def _specs(self) -> list[tuple[str, str]]:
        return [tuple((*c.split(":"), "")[:2]) for c in self.columns.split()]

    def frame(self, spark: SparkSession, directory: str) -> DataFrame:
        ensure_scratch(spark)
        df = self.run(spark, directory)
        if self.columns is None:
            return df
        kinds = {"": lambda c: c, "int": lambda c: c.cast("int"), "long": lambda c: c.cast("long"),
                 "text": lambda c: c.cast("string")}

        def shaped(c, kind: str):
            if kind in kinds:
                return kinds[kind](c)
            if kind.startswith("r"):
                return F.round(c.cast("double"), int(kind[1:])) + 0.0
            if kind.startswith("s"):
                unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.nullif(c, F.lit(0.0))))))
                return F.coalesce(F.round(c / unit, int(kind[1:]) - 1) * unit, c)
            return F.round(c.cast("double") + nudge(kind), int(kind)) + 0.0

        return df.select(*[shaped(F.col(name), kind).alias(name) for name, kind in self._specs()])

    def sql(self) -> str | None:
        if self.final is None:
            return None
        kinds = {"": "{0}", "int": "CAST({0} AS INTEGER)", "long": "CAST({0} AS BIGINT)",
                 "text": "CAST({0} AS VARCHAR)"}

        def shaped(kind: str) -> str:
            if kind in kinds:
                return kinds[kind]
            if kind.startswith("r"):
                return f"round(CAST({{0}} AS DOUBLE), {kind[1:]}) + 0.0"
            if kind.startswith("s"):
                unit = "pow(10.0, floor(log10(abs(nullif({0}, 0)))))"
                return f"coalesce(round({{0}} / {unit}, {int(kind[1:]) - 1}) * {unit}, {{0}})"
            return f"round(CAST({{0}} AS DOUBLE) + {nudge(kind)!r}, {kind}) + 0.0"

        picked = ", ".join(shaped(kind).format(f'"{name}"') + f' AS "{name}"'
                           for name, kind in self._specs())
        with_clause = "WITH RECURSIVE " + ",\n".join(self.ctes) + "\n" if self.ctes else ""
        return f"{with_clause}SELECT {picked} FROM (\n{self.final}\n) result"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str | None = None, ctes: Sequence[str] = (),
          final: str | None = None):
    def add(run):
        REGISTRY[name] = Query(run, columns, ctes, final)
        return run
    return add


def sessions_query(name: str, operator: Callable[[DataFrame], DataFrame], columns: str,
                   final: str, ctes: Sequence[str] = (), view=session_view) -> None:
    """A query that is one operator applied to the session view."""
    REGISTRY[name] = Query(lambda spark, d: operator(view(spark, d)), columns,
                           [S.SESSIONS, *ctes], final)


def cleaned_query(name: str, operator: Callable[[DataFrame], DataFrame], columns: str,
                  final: str, ctes: Sequence[str] = ()) -> None:
    """A query that is one operator applied to the cleaned sessions."""
    REGISTRY[name] = Query(lambda spark, d: operator(cleaned_sessions(spark, d)), columns,
                           [*S.CLEANED, *ctes], final)


def plan(spark: SparkSession, directory: str, *parts: str, method: str = "lloyd",
         **kwargs) -> UsagePlan:
    return UsagePlan(cleaned_sessions(spark, directory), cleaned=True,
                     parts=parts or ("engagement", "experience"), method=method, **kwargs)


def rounded_experience(spark: SparkSession, directory: str) -> DataFrame:
    """Cleaned per-user quality, rounded so that equal values are equal everywhere."""
    table = plan(spark, directory, "experience").experience
    return table.withColumns({m: F.round(m, 4) for m in EXPERIENCE_METRICS})


def doubles(names: Sequence[str], digits: int) -> str:
    return " ".join(f"{n}:{digits}" for n in names)


ID = "bearer_id:long user_id:long start_ts handset_manufacturer handset_type"
GRAINED = S.VIEW_APPS + ["total_dl", "total_ul"]
QUALITY_SPEC = doubles(["dur_ms", *S.QUALITY], 6)

# -- sources and cleaning ----------------------------------------------------

sessions_query("load_sessions", lambda s: s,
               f"{ID} {QUALITY_SPEC} {doubles(GRAINED, 4)}", "SELECT * FROM s")


@query("field_dictionary", "variable kind description dtype filled:long", [S.SESSIONS],
       S.FIELD_DICTIONARY)
def _field_dictionary(spark, d):
    return statistics.field_dictionary(session_view(spark, d))


ROW_SPEC = f"bearer_id:long user_id:long {QUALITY_SPEC} {doubles(GRAINED, 4)}"
sessions_query("impute_numeric_mean",
               lambda s: cleaning.impute(s.select("bearer_id", "user_id", *S.MEASURES)), ROW_SPEC,
               "SELECT * REPLACE (trunc(user_id) AS user_id) FROM i",
               S.imputed(["user_id", *S.MEASURES], ["bearer_id"]))

sessions_query("impute_category_mode",
               lambda s: cleaning.impute(s.select("bearer_id", "user_id", "handset_manufacturer",
                                                  "handset_type")),
               "bearer_id:long user_id:long handset_manufacturer handset_type",
               "SELECT bearer_id, coalesce(user_id, (SELECT trunc(avg(user_id)) FROM s)) AS "
               "user_id, " + ", ".join(f"coalesce({c}, (SELECT {c} FROM s WHERE {c} IS NOT NULL GROUP BY {c} "
                           f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
                           for c in ("handset_manufacturer", "handset_type")) + " FROM s")

sessions_query("outlier_iqr_replace",
               lambda s: cleaning.replace_outliers(s.select("bearer_id", "user_id", *S.MEASURES)),
               ROW_SPEC, "SELECT * FROM c", S.fenced(S.MEASURES, ["bearer_id", "user_id"], "s"),
               view=joined_once)

sessions_query("total_data",
               lambda s: cleaning.add_total(s.select("bearer_id", "user_id", "total_dl",
                                                     "total_ul")),
               "bearer_id:long user_id:long total_dl:4 total_ul:4 total_data:4",
               "SELECT *, total_dl + total_ul AS total_data FROM s")


@query("safe_int_cast", "l_orderkey wide fits l_linenumber:long", [],
       "SELECT l_orderkey, CAST((CAST(l_orderkey AS HUGEINT) + 10000000) * 1000000000000000 "
       "AS VARCHAR) AS wide, l_orderkey * 1000 AS fits, l_linenumber FROM lineitem")
def _safe_int_cast(spark, d):
    line = read_table(spark, d, "lineitem")
    return cleaning.safe_integers(line.select(
        "l_orderkey",
        ((F.col("l_orderkey").cast("decimal(20,0)") + 10_000_000)
         * F.lit("1000000000000000").cast("decimal(16,0)")).cast("decimal(38,0)").alias("wide"),
        (F.col("l_orderkey") * 1000).cast("decimal(20,0)").alias("fits"), "l_linenumber"))


sessions_query("summarize_numeric", statistics.summarize,
               "variable count:long mean:3 std:3 min:3 q25:3 q50:3 q75:3 max:3",
               "SELECT variable, count(value) AS count, avg(value) AS mean, "
               "stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, "
               "quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, "
               "max(value) AS max FROM l GROUP BY variable",
               ["l AS (" + S.long_form(["bearer_id", "user_id", *S.MEASURES]) + ")"])


CLEAN_SPEC = f"{ID} {QUALITY_SPEC} {doubles([*GRAINED, 'total_data'], 4)}"


@query("clean_sessions", CLEAN_SPEC, S.CLEANED, "SELECT * FROM s")
def _clean_sessions(spark, d):
    return cleaning.clean(joined_once(spark, d))


@query("cleaned_roundtrip", CLEAN_SPEC, S.CLEANED, "SELECT * FROM s")
def _cleaned_roundtrip(spark, d):
    """A table stored for another input is noticed and rebuilt, the rebuilt one is used.

    The input are joined rows, which the sessions are a projection of and which take an eighth of
    their room.
    """
    rows = stored_rows(spark, d)
    source, path = scratch_path(spark, "sessions"), scratch_path(spark, "cleaned")

    def stored(make):
        return files.load_or_create_cleaned(spark, path, make, inputs=[source])

    def read():
        return session_view(spark, d, spark.read.parquet(source))

    files.save_feature(rows.where(session_user().isNull()), source)
    stored(read)
    files.save_feature(rows, source)
    stored(read)

    def never():
        raise AssertionError("the stored table must be used")
    return stored(never)


def _written_sessions(spark, d, file_format: str) -> str:
    """The session view in a file as sessions come: raw header between blanks, and in a CSV file
    some cells that are no numbers."""
    path, view = scratch_path(spark, f"raw_{file_format}"), session_view(spark, d)
    if file_format == "csv":
        text = [F.when(F.col("bearer_id") % n == 0, F.lit(bad)).otherwise(F.col(c).cast("string"))
                .alias(c) if (n, bad) != (0, "") else F.col(c) for c in view.columns
                for n, bad in [{"dur_ms": (7, "n/a"), "rtt_ul_ms": (11, "fast")}.get(c, (0, ""))]]
        files.write_sessions_csv(files.raw_header(view.select(*text), pad="  "), path)
    else:
        files.raw_header(view, pad=" ").write.parquet(path)
    return path


_REFUSED = "CASE WHEN bearer_id % {0} = 0 THEN NULL ELSE {1} END"


@query("load_sessions_csv", f"{ID} {QUALITY_SPEC} {doubles(GRAINED, 4)} rejected:text", [S.SESSIONS],
       f"SELECT * REPLACE ({_REFUSED.format(7, 'dur_ms')} AS dur_ms, "
       f"{_REFUSED.format(11, 'rtt_ul_ms')} AS rtt_ul_ms), concat_ws(',', CASE WHEN bearer_id % 7 = 0 "
       "THEN 'dur_ms' END, CASE WHEN bearer_id % 11 = 0 THEN 'rtt_ul_ms' END) AS rejected FROM s")
def _load_sessions_csv(spark, d):
    found = files.read_sessions(spark, _written_sessions(spark, d, "csv"), "csv", rejected="refused")
    return found.withColumns({"start_ts": F.col("start_ts").cast("timestamp_ntz"),
                              "rejected": F.array_join("refused", ",")})


query("load_sessions_parquet", f"{ID} {QUALITY_SPEC} {doubles(GRAINED, 4)}", [S.SESSIONS],
      "SELECT * FROM s")(
    lambda spark, d: files.read_sessions(spark, _written_sessions(spark, d, "parquet")))


@query("rejected_cells", "variable rows:long", [S.SESSIONS],
       "SELECT 'dur_ms' AS variable, count(*) AS rows FROM s WHERE bearer_id % 7 = 0 UNION ALL "
       "SELECT 'rtt_ul_ms', count(*) FROM s WHERE bearer_id % 11 = 0")
def _rejected_cells(spark, d):
    path = _written_sessions(spark, d, "csv")
    return files.rejection_counts(files.read_sessions(spark, path, "csv", rejected="bad"), "bad")


@query("field_descriptions", "variable kind description dtype filled:long", [S.SESSIONS],
       S.FIELD_DICTIONARY)
def _field_descriptions(spark, d):
    """The dictionary written as a file with blanks around its header, and read again."""
    path = scratch_path(spark, "fields")
    table = statistics.field_dictionary(session_view(spark, d))
    table.toDF(*[f" {c}  " for c in table.columns]).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return files.read_field_descriptions(spark, path)


ENG_SPEC = ("user_id:long sessions_frequency:long total_duration_ms:2 total_dl_bytes:2 "
            "total_ul_bytes:2 total_traffic_bytes:2")


@query("feature_roundtrip", ENG_SPEC, [*S.CLEANED, S.engagement()], "SELECT * FROM eng")
def _feature_roundtrip(spark, d):
    path = scratch_path(spark, "feature")
    files.save_feature(features.user_engagement(cleaned_sessions(spark, d)), path)
    return files.load_feature(spark, path)


# -- per-user features -------------------------------------------------------

cleaned_query("user_overview", features.user_overview,
               "user_id:long sessions_count:long total_duration_ms:2 total_dl_bytes:2 "
               "total_ul_bytes:2 total_data_bytes:2 "
               + doubles([f"{c}_sum" for c in S.APP_COLUMNS], 2)
               + " handset_manufacturer handset_type",
               "SELECT ov.*, m.handset_manufacturer, t.handset_type FROM ov "
               "LEFT JOIN last_handset_manufacturer m USING (user_id) "
               "LEFT JOIN last_handset_type t USING (user_id)",
               [S.overview(), *S.last_handset()])
cleaned_query("user_last_handset", features.user_last_handset,
               "user_id:long handset_manufacturer handset_type",
               "SELECT u.user_id, m.handset_manufacturer, t.handset_type "
               "FROM (SELECT DISTINCT user_id FROM s WHERE user_id IS NOT NULL) u "
               "LEFT JOIN last_handset_manufacturer m USING (user_id) "
               "LEFT JOIN last_handset_type t USING (user_id)", S.last_handset())
cleaned_query("user_engagement", features.user_engagement, ENG_SPEC, "SELECT * FROM eng",
               [S.engagement()])
cleaned_query("user_app_traffic", features.user_app_traffic,
               "user_id:long " + doubles([f"{a}_total_bytes" for a in S.APPS], 2),
               "SELECT * FROM app", [S.traffic()])
EXP_SPEC = ("user_id:long avg_tcp_dl_retrans:4 avg_tcp_ul_retrans:4 avg_rtt_dl_ms:4 "
            "avg_rtt_ul_ms:4 avg_throughput_dl_kbps:4 avg_throughput_ul_kbps:4 "
            "avg_tcp_retransmission:4 avg_rtt_ms:4 avg_throughput_kbps:4 handset_type")
cleaned_query("user_experience", features.user_experience, EXP_SPEC, "SELECT * FROM exp",
               S.experience())
cleaned_query("user_modal_handset", features.user_modal_handset, "user_id:long handset_type",
               "SELECT u.user_id, coalesce(m.handset_type, 'Unknown') AS handset_type "
               "FROM (SELECT DISTINCT user_id FROM s WHERE user_id IS NOT NULL) u LEFT JOIN modal m USING (user_id)",
               [S.MODAL.format(source="s")])


@query("cleaned_user_experience", EXP_SPEC, S.clean_experience(), "SELECT * FROM exp")
def _cleaned_user_experience(spark, d):
    return plan(spark, d, "experience").experience


_MERGED_SPEC = ("user_id:long sessions_frequency:long total_duration_ms:2 total_dl_bytes:2 "
                "total_ul_bytes:2 total_traffic_bytes:2 total_data_bytes:2 "
                + doubles([f"{c}_sum" for c in S.APP_COLUMNS] + [f"{a}_total_bytes" for a in S.APPS], 2)
                + " " + EXP_SPEC.removeprefix("user_id:long ").removesuffix(" handset_type")
                + " modal_handset last_handset_manufacturer last_handset_type")


@query("incremental_features", _MERGED_SPEC,
       [*S.CLEANED, S.engagement(), S.traffic(), S.overview(), *S.experience(), *S.last_handset()],
       "SELECT eng.*, ov.* EXCLUDE (user_id, total_duration_ms, total_dl_bytes, total_ul_bytes), "
       "app.* EXCLUDE (user_id), exp.* EXCLUDE (user_id, handset_type), exp.handset_type AS modal_handset, "
       "m.handset_manufacturer AS last_handset_manufacturer, t.handset_type AS last_handset_type FROM eng "
       "JOIN ov ON ov.user_id = eng.user_id JOIN app ON app.user_id = eng.user_id "
       "JOIN exp ON exp.user_id = eng.user_id "
       "LEFT JOIN last_handset_manufacturer m ON m.user_id = eng.user_id "
       "LEFT JOIN last_handset_type t ON t.user_id = eng.user_id")
def _incremental_features(spark, d):
    """All sessions in three batches by year, the second one added twice: as if read at once."""
    sessions, kept = cleaned_sessions(spark, d), IncrementalFeatures(spark, scratch_path(spark, "state"))
    for batch in (1, 0, 0, 2):
        kept.add(f"years {batch}", sessions.where(F.coalesce(F.year("start_ts"), F.lit(0)) % 3 == batch))
    return kept.features(sessions)


# -- overview ----------------------------------------------------------------

def counted(column: str, n: int) -> str:
    return (f"SELECT {column}, count(*) AS session_count FROM s WHERE {column} IS NOT NULL "
            f"GROUP BY {column} ORDER BY session_count DESC, {column} LIMIT {n}")


cleaned_query("top_handsets", ranking.top_handsets, "handset_type session_count:long",
               counted("handset_type", 10))
cleaned_query("top_manufacturers", ranking.top_manufacturers,
               "handset_manufacturer session_count:long", counted("handset_manufacturer", 3))
cleaned_query("top_manufacturers_10", partial(ranking.top_manufacturers, n=10),
               "handset_manufacturer session_count:long", counted("handset_manufacturer", 10))
cleaned_query("market_share", ranking.market_share,
               "handset_manufacturer session_count:long share_pct:6",
               "SELECT *, 100.0 * session_count / sum(session_count) OVER () AS share_pct FROM ("
               + counted("handset_manufacturer", 3) + ")")
cleaned_query("top_handsets_per_manufacturer", ranking.top_handsets_per_manufacturer,
               "handset_manufacturer rank:int handset_type session_count:long",
               "SELECT * FROM (SELECT handset_manufacturer, handset_type, count(*) AS session_count, "
               "row_number() OVER (PARTITION BY handset_manufacturer ORDER BY count(*) DESC, "
               "handset_type) AS rank FROM s WHERE handset_type IS NOT NULL AND handset_manufacturer "
               f"IN (SELECT handset_manufacturer FROM ({counted('handset_manufacturer', 3)})) "
               "GROUP BY handset_manufacturer, handset_type) WHERE rank <= 5")

_ALL = ["l AS (" + S.long_form(["bearer_id", "user_id", *S.MEASURES, "total_data"]) + ")"]
_DTYPES = [("bearer_id", "bigint"), ("user_id", "bigint"), ("start_ts", "timestamp_ntz"),
           ("handset_manufacturer", "string"), ("handset_type", "string"),
           *[(c, "double") for c in [*S.MEASURES, "total_data"]]]
cleaned_query("describe_variables", statistics.describe_variables,
               "variable dtype mean:3 std:3 min:3 max:3",
               "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in _DTYPES)
               + ") d(variable, dtype) LEFT JOIN (SELECT variable, avg(value) AS mean, "
               "stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM l "
               "GROUP BY variable) USING (variable)", _ALL)
cleaned_query("basic_metrics", statistics.basic_metrics,
              "variable mean:3 median:3 std:3 variance:s8 skewness:6 kurtosis:6 missing:long",
              "SELECT variable, avg(value) AS mean, median(value) AS median, "
              "stddev_samp(value) AS std, var_samp(value) AS variance, "
              "skewness(value) AS skewness, kurtosis(value) AS kurtosis, "
              "count(*) - count(value) AS missing FROM l "
              "WHERE variable NOT IN ('bearer_id', 'user_id') GROUP BY variable", _ALL)
cleaned_query("dispersion", statistics.dispersion,
               "variable q1:5 q3:5 iqr:5 range:5 cv_pct:r2",
               "SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, "
               "quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, "
               "max(value) - min(value) AS range, "
               "stddev_samp(value) / nullif(avg(value), 0) * 100 AS cv_pct FROM l GROUP BY variable",
               _ALL)

_HIST = ["dur_ms", "total_dl", "total_ul", "rtt_dl_ms", "tp_dl_kbps"]
_HIST_SPEC = "bin:int bin_start:3 bin_end:3 count:long"
cleaned_query("histogram", lambda s: statistics.histogram(s, _HIST, 50),
               f"variable {_HIST_SPEC}", S.histograms(S.long_form(_HIST), 50))
_METRIC_HIST = ["dur_ms", "rtt_dl_ms", "rtt_ul_ms", "tp_dl_kbps", "tp_ul_kbps"]
cleaned_query("session_metric_histograms",
               lambda s: statistics.histogram(s, _METRIC_HIST, 60),
               f"variable {_HIST_SPEC}", S.histograms(S.long_form(_METRIC_HIST), 60))
cleaned_query("histogram_by_group",
               lambda s: statistics.histogram(s, ["tp_dl_kbps", "rtt_dl_ms"], 80,
                                              by="handset_manufacturer"),
               f"variable handset_manufacturer {_HIST_SPEC}",
               S.histograms(S.long_form(["tp_dl_kbps", "rtt_dl_ms"],
                                        keep=["handset_manufacturer"]), 80,
                            "handset_manufacturer"))

_APP_VOLUME = {a: f"coalesce({a}_dl, 0) + coalesce({a}_ul, 0)" for a in S.APPS}
cleaned_query("app_total_correlation", statistics.app_total_correlation,
               "application correlation:r4",
               " UNION ALL ".join(f"SELECT '{a}' AS application, "
                                  f"corr({v}, total_dl + total_ul) AS correlation FROM s"
                                  for a, v in _APP_VOLUME.items()))
cleaned_query("app_total_grid", statistics.app_total_grid,
               "application x_bin:int y_bin:int count:long",
               "SELECT variable AS application, x_bin, y_bin, count FROM ("
               + S.grids(" UNION ALL ".join(
                   f"SELECT '{a}' AS variable, ({v}) / 1e6 AS x, (total_dl + total_ul) / 1e6 AS y "
                   "FROM s" for a, v in _APP_VOLUME.items()), 20) + ")")
cleaned_query("decile_segmentation",
               lambda s: segments.decile_segmentation(features.user_overview(s)),
               "decile decile_num:int total_data_bytes_sum:2",
               "SELECT 'D' || dn AS decile, dn AS decile_num, sum(total_data_bytes) AS "
               "total_data_bytes_sum FROM (SELECT *, greatest(1, ((r - 1) * 10 + n - 2) // (n - 1)) "
               "AS dn FROM (SELECT *, row_number() OVER (ORDER BY total_duration_ms, user_id) AS r, "
               "count(*) OVER () AS n FROM ov)) WHERE dn >= 6 GROUP BY dn", [S.overview()])
cleaned_query("correlation_matrix", statistics.app_correlation_matrix, "col_a col_b r:6",
               " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM s"
                                  for a in S.APP_COLUMNS for b in S.APP_COLUMNS))
cleaned_query("correlation_matrix_users",
               lambda s: statistics.app_correlation_matrix(
                   s, materialise(features.user_app_traffic(s), "traffic"), level="user"),
               "col_a col_b r:6",
               " UNION ALL ".join(f"SELECT '{a}_total_bytes' AS col_a, '{b}_total_bytes' AS col_b, "
                                  f"corr({a}_total_bytes, {b}_total_bytes) AS r FROM app"
                                  for a in S.APPS for b in S.APPS), [S.traffic()])
sessions_query("correlation_with_gaps",
               lambda s: statistics.correlation_matrix(s, S.QUALITY), "col_a col_b r:6",
               " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM s"
                                  for a in S.QUALITY for b in S.QUALITY))


_PCA = S.components(S.APP_COLUMNS)
_ENTRIES = {c: [f"max(v) FILTER (WHERE c = {c} AND i = {i + 1})" for i in range(len(S.APP_COLUMNS))]
            for c in (1, 2)}
_VARIABLES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(S.APP_COLUMNS, 1))


def app_components(s: DataFrame) -> components.Components:
    return components.fit_components(s, DEFAULT.app_columns(s))


cleaned_query("pca_explained", lambda s: app_components(s).explained(s),
              "component explained_ratio:8 explained_pct:6",
              f"SELECT 'PC' || c AS component, l / {len(S.APP_COLUMNS)} AS explained_ratio, "
              f"100.0 * l / {len(S.APP_COLUMNS)} AS explained_pct FROM pc", _PCA)
cleaned_query("pca_loadings", lambda s: app_components(s).loadings(s), "variable PC1:7 PC2:7",
              "SELECT variable, max(v) FILTER (WHERE c = 1) AS PC1, max(v) FILTER (WHERE c = 2) AS PC2 "
              f"FROM pv JOIN (VALUES {_VARIABLES}) n(i, variable) USING (i) GROUP BY variable", _PCA)
cleaned_query("pca_scores", lambda s: app_components(s).scores(s, ["bearer_id"]),
              "bearer_id:long PC1:6 PC2:6",
              "SELECT bearer_id, " + ", ".join(
                  " + ".join(f"z{i} * e{c}_{i}" for i in range(1, len(S.APP_COLUMNS) + 1))
                  + f" AS PC{c}" for c in (1, 2)) + " FROM pz, (SELECT "
              + ", ".join(f"{e} AS e{c}_{i}" for c in (1, 2) for i, e in enumerate(_ENTRIES[c], 1))
              + " FROM pv)", _PCA)
cleaned_query("app_boxplot_stats", statistics.app_box_statistics,
               "application count:long mean:3 min:3 whisker_low:3 q1:3 median:3 q3:3 "
               "whisker_high:3 max:3 outliers:long",
               S.boxes("(" + " UNION ALL ".join(
                   f"SELECT '{a}' AS application, {a}_dl AS value FROM s" for a in S.APPS) + ")",
                   "application"))
BOX_SPEC = ("count:long mean:4 min:4 whisker_low:4 q1:4 median:4 q3:4 whisker_high:4 max:4 "
            "outliers:long")
cleaned_query("boxplot_stats",
               lambda s: statistics.box_statistics(
                   to_long(s, ["tp_dl_kbps"], keep=["handset_manufacturer"]),
                   "handset_manufacturer"),
               f"handset_manufacturer {BOX_SPEC}", S.boxes("s", "handset_manufacturer",
                                                           "tp_dl_kbps"))
for _name, _group in (("boxplot_by_handset", "handset_type"), ("boxplot_by_user", "user_id:long")):
    _plain = _group.split(":")[0]
    cleaned_query(_name, partial(lambda g, s: statistics.keyed_box_statistics(
        to_long(s, ["tp_dl_kbps"], keep=[g]), g), _plain), f"{_group} {BOX_SPEC}",
        S.boxes("s", _plain, "tp_dl_kbps"))
cleaned_query("kpi_banner", reports.kpi_banner,
               "total_records:long unique_users:long handset_types:long total_dl_tb:6 "
               "total_ul_tb:6",
               "SELECT count(*) AS total_records, count(DISTINCT user_id) AS unique_users, "
               "count(DISTINCT handset_type) AS handset_types, sum(total_dl) / 1e12 AS total_dl_tb, "
               "sum(total_ul) / 1e12 AS total_ul_tb FROM s")



@query("kpi_banner_sketches", "total_records:long total_dl_tb:6 total_ul_tb:6 users_within:text "
       "handsets_within:text close_to_rebuilt:text", S.CLEANED,
       "SELECT count(*) AS total_records, sum(total_dl) / 1e12 AS total_dl_tb, sum(total_ul) / 1e12 AS "
       "total_ul_tb, 'true' AS users_within, 'true' AS handsets_within, 'true' AS close_to_rebuilt FROM s")
def _kpi_banner_sketches(spark, d):
    """Figures united from stored days: estimates within four standard errors of the exact counts,
    and as close to those of a sketch built from all sessions at once."""
    sessions, path = cleaned_sessions(spark, d), scratch_path(spark, "days")
    files.save_feature(sketches.daily_figures(sessions), path)
    days = sketches.banner(files.load_feature(spark, path))
    exact = reports.kpi_banner(sessions).select(F.col("unique_users").alias("u"),
                                                F.col("handset_types").alias("h"))
    whole = sessions.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("user_id").cast("long"),
                                                                sketches.LG)).alias("rebuilt"))

    def within(estimate: str, truth: str):
        return F.abs(F.col(estimate) - F.col(truth)) <= 4 * sketches.ERROR * F.col(truth) + 0.5

    return days.join(exact).join(whole).withColumns({  # three rows of one
        "users_within": within("unique_users", "u"), "handsets_within": within("handset_types", "h"),
        "close_to_rebuilt": F.abs(F.col("unique_users") - F.col("rebuilt"))
        <= 4 * sketches.ERROR * F.col("rebuilt")})


# -- engagement --------------------------------------------------------------


def ranked(metrics: Sequence[str], source: str, n: int, variable: str = "metric",
           strip: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m.removesuffix(strip)}' AS {variable}, row_number() OVER "
        f"(ORDER BY {m} DESC, user_id) AS rank, user_id, CAST({m} AS DOUBLE) AS value FROM {source}) "
        f"WHERE rank <= {n}" for m in metrics)


cleaned_query("top10_per_metric", lambda s: ranking.top_engaged(features.user_engagement(s)),
               "metric rank:int user_id:long value:2", ranked(S.ENG, "eng", 10), [S.engagement()])
cleaned_query("top10_per_app", lambda s: ranking.top_per_application(features.user_app_traffic(s)),
               "application rank:int user_id:long value:2",
               ranked([f"{a}_total_bytes" for a in S.APPS], "app", 10, "application",
                      "_total_bytes"), [S.traffic()])
cleaned_query("top3_apps", lambda s: ranking.top_applications(features.user_app_traffic(s)),
               "application total_bytes:0 total_gb:4",
               "SELECT *, total_bytes / 1e9 AS total_gb FROM ("
               + " UNION ALL ".join(f"SELECT '{a}' AS application, sum({a}_total_bytes) AS "
                                    "total_bytes FROM app" for a in S.APPS)
               + ") ORDER BY total_bytes DESC, application LIMIT 3", [S.traffic()])

ENGC = S.engagement_clusters()


@query("engagement_clusters", ENG_SPEC + " engagement_cluster:int", ENGC, "SELECT * FROM engc")
def _engagement_clusters(spark, d):
    return plan(spark, d, "engagement").engagement_clustered


@query("engagement_clusters_ml")
def _engagement_clusters_ml(spark, d):
    return plan(spark, d, "engagement", method="ml").engagement_clustered


def engagement_table(operator, *more):
    """Query body: an operator over clustered users and the cluster column."""
    return lambda spark, d: operator(plan(spark, d, "engagement").engagement_clustered,
                                     "engagement_cluster", *more)


query("engagement_cluster_stats",
      "engagement_cluster:int " + " ".join(f"{m}_{n}:2" for m in S.ENG
                                           for n in ("min", "max", "mean", "sum")),
      [*ENGC, S.statistics("engc", "engagement_cluster", S.ENG, "st")], "SELECT * FROM st")(
    engagement_table(clustering.cluster_statistics, ENGAGEMENT_METRICS))
query("engagement_cluster_share",
      "engagement_cluster:int user_count:long " + " ".join(f"{m}_total:2" for m in S.ENG)
      + " user_pct:6 " + " ".join(f"{m}_pct:6" for m in S.ENG),
      [*ENGC, S.share("engc", "engagement_cluster", S.ENG, "sh")], "SELECT * FROM sh")(
    engagement_table(clustering.cluster_share, ENGAGEMENT_METRICS))
query("engagement_labels", "engagement_cluster:int rank:int label", [*ENGC, S.ENG_LABELS],
      "SELECT * FROM engl")(
    engagement_table(clustering.engagement_labels, ENGAGEMENT_METRICS))

_PAIRS = [("sessions_frequency", "total_traffic_bytes"),
          ("total_duration_ms", "total_traffic_bytes"),
          ("sessions_frequency", "total_duration_ms")]
query("engagement_cluster_grid", "pair engagement_cluster:int x_bin:int y_bin:int count:long",
      ENGC, "SELECT variable AS pair, engagement_cluster, x_bin, y_bin, count FROM ("
      + S.grids(" UNION ALL ".join(
          f"SELECT '{x} vs {y}' AS variable, engagement_cluster, CAST({x} AS DOUBLE) AS x, "
          f"CAST({y} AS DOUBLE) AS y FROM engc" for x, y in _PAIRS), 16, "engagement_cluster")
      + ")")(engagement_table(clustering.cluster_grid, _PAIRS, 16))


def _elbow_oracle() -> tuple[list[str], str]:
    ctes, ks = [*S.CLEANED, S.engagement()], range(2, 11)
    for k in ks:
        ctes += S.lloyd("eng", S.ENG, "minmax", k, f"e{k}")
    ctes.append(S.scaled("eng", S.ENG, "minmax", "ez"))
    ctes.append("curve AS (SELECT 1 AS k, (var_pop(x0) + var_pop(x1) + var_pop(x2)) * count(*) AS "
                "inertia FROM ez" + "".join(f" UNION ALL SELECT {k}, sum(d) FROM e{k}"
                                            for k in ks) + ")")
    ctes.append("bent AS (SELECT *, lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) "
                "OVER (ORDER BY k) AS second_difference FROM curve)")
    return ctes, ("SELECT *, (SELECT k FROM bent WHERE second_difference IS NOT NULL ORDER BY "
                  "second_difference DESC, k LIMIT 1) AS optimal_k FROM bent")


@query("elbow_curve", "k:int inertia:4 second_difference:4 optimal_k:int", *_elbow_oracle())
def _elbow_curve(spark, d):
    return clustering.elbow(plan(spark, d, "engagement").engagement, "user_id",
                            ENGAGEMENT_METRICS, 10, method="lloyd")


@query("elbow_curve_ml")
def _elbow_curve_ml(spark, d):
    return clustering.elbow(plan(spark, d, "engagement").engagement, "user_id",
                            ENGAGEMENT_METRICS, 10, method="ml")


def restart_costs(df: DataFrame, features: Sequence[str], ks: Sequence[int], scaling: str) -> DataFrame:
    """Per k the starts, the cost of the rank-chosen one, and whether the kept fit is no dearer."""
    found = clustering.restarted_many(df, "user_id", features, ks, scaling)
    rows = [(k, len(f.costs), f.costs[0], f.cost <= f.costs[0]) for k, f in found.items()]
    return df.sparkSession.createDataFrame(rows, "k int, starts int, rank_cost double, no_dearer boolean")


COST_SPEC = "k:int starts:int rank_cost:4 no_dearer"


@query("engagement_restarts", COST_SPEC, _elbow_oracle()[0],
       "SELECT k, 10 AS starts, inertia AS rank_cost, true AS no_dearer FROM curve WHERE k > 1")
def _engagement_restarts(spark, d):
    return restart_costs(plan(spark, d, "engagement").engagement, ENGAGEMENT_METRICS,
                         range(2, 11), "minmax")


@query("elbow_curve_restarts")
def _elbow_curve_restarts(spark, d):
    return clustering.elbow(plan(spark, d, "engagement").engagement, "user_id",
                            ENGAGEMENT_METRICS, 10)


ENGSEG = [*ENGC, S.ENG_LABELS, S.statistics("engc", "engagement_cluster", S.ENG, "st"),
          S.share("engc", "engagement_cluster", S.ENG, "sh")]
_JOINED = ("st JOIN sh USING (engagement_cluster) JOIN engl USING (engagement_cluster)")


def engagement_report(operator):
    def run(spark, d):
        p = plan(spark, d, "engagement")
        return operator(p.engagement_clustered, p.engagement_labels)
    return run


query("engagement_segments",
      "cluster classification users:long users_pct:r1 sessions_min:long sessions_max:long "
      "sessions_avg:r2 sessions_total:long duration_avg_hours:r2 traffic_avg_mb:r2 "
      "traffic_total_gb:r2 traffic_pct:r1", ENGSEG,
      "SELECT 'Cluster ' || engagement_cluster AS cluster, label AS classification, user_count AS "
      "users, user_pct AS users_pct, sessions_frequency_min AS sessions_min, "
      "sessions_frequency_max AS sessions_max, sessions_frequency_mean AS sessions_avg, "
      "sessions_frequency_sum AS sessions_total, total_duration_ms_mean / 3600000 AS "
      "duration_avg_hours, total_traffic_bytes_mean / 1e6 AS traffic_avg_mb, "
      "total_traffic_bytes_sum / 1e9 AS traffic_total_gb, total_traffic_bytes_pct AS traffic_pct "
      "FROM " + _JOINED)(engagement_report(reports.engagement_segments))
query("engagement_key_finding",
      "high_user_pct:6 high_traffic_pct:6 session_ratio:6 traffic_ratio:6", ENGSEG,
      "SELECT h.user_pct AS high_user_pct, h.total_traffic_bytes_pct AS high_traffic_pct, "
      "h.sessions_frequency_mean / o.sessions_frequency_mean AS session_ratio, "
      "h.total_traffic_bytes_mean / o.total_traffic_bytes_mean AS traffic_ratio "
      f"FROM (SELECT * FROM {_JOINED} WHERE label = 'High') h, "
      f"(SELECT * FROM {_JOINED} WHERE label = 'Low') o")(
    engagement_report(reports.engagement_key_finding))
query("engagement_means_long", "cluster label metric mean_value:2", ENGSEG,
      " UNION ALL ".join(f"SELECT engagement_cluster || ' - ' || label AS cluster, label, '{m}' AS "
                         f"metric, {m}_mean AS mean_value FROM {_JOINED}" for m in S.ENG))(
    engagement_report(lambda users, labels: reports.means_long(
        users, labels, "engagement_cluster", ENGAGEMENT_METRICS)))
query("labelled_users", "user_id:long engagement_cluster:int segment", [*ENGC, S.ENG_LABELS],
      "SELECT user_id, engagement_cluster, engagement_cluster || ' - ' || label AS segment "
      "FROM engc JOIN engl USING (engagement_cluster)")(
    engagement_report(lambda users, labels: clustering.labelled(
        users, labels, "engagement_cluster", "segment")))

# -- experience --------------------------------------------------------------

EXP4 = S.clean_experience(4)


def extremes_sql(metrics: Sequence[str], n: int) -> str:
    none = "CAST(NULL AS BIGINT)"
    rows = []
    for m in metrics:
        for kind, order in (("top", "DESC"), ("bottom", "ASC")):
            rows.append(
                f"SELECT '{m}' AS metric, '{kind}' AS kind, * FROM (SELECT row_number() OVER (ORDER "
                f"BY {m} {order}, user_id) AS rank, user_id, {m} AS value, {none} AS count FROM exp "
                f"WHERE {m} IS NOT NULL) WHERE rank <= {n}")
        rows.append(
            f"SELECT '{m}' AS metric, 'most_frequent' AS kind, * FROM (SELECT row_number() OVER "
            f"(ORDER BY count(*) DESC, {m}) AS rank, {none} AS user_id, {m} AS value, count(*) AS "
            f"count FROM exp WHERE {m} IS NOT NULL GROUP BY {m}) WHERE rank <= {n}")
    return " UNION ALL ".join(rows)


query("experience_extremes", "metric kind rank:int user_id:long value:4 count:long", EXP4,
      extremes_sql(S.EXP, 10))(
    lambda spark, d: ranking.experience_extremes(materialise(rounded_experience(spark, d))))
query("top_bottom_frequent", "kind rank:int user_id:long value:4 count:long", EXP4,
      extremes_sql(["avg_rtt_ms"], 10))(
    lambda spark, d: ranking.top_bottom_frequent(rounded_experience(spark, d), "avg_rtt_ms"))


def handset_query(name: str, operator, metric: str, order: str) -> None:
    query(name, f"handset_type {metric}:4", S.clean_experience(),
          f"SELECT handset_type, avg({metric}) AS {metric} FROM exp GROUP BY handset_type "
          f"ORDER BY avg({metric}) {order}, handset_type LIMIT 10")(
        lambda spark, d: operator(plan(spark, d, "experience").experience))


handset_query("throughput_per_handset", ranking.throughput_per_handset, "avg_throughput_kbps", "DESC")
handset_query("throughput_bottom_handsets", ranking.throughput_bottom_handsets,
              "avg_throughput_kbps", "ASC")
handset_query("tcp_per_handset", ranking.tcp_per_handset, "avg_tcp_retransmission", "DESC")
handset_query("tcp_best_handsets", ranking.tcp_best_handsets, "avg_tcp_retransmission", "ASC")


def ends_sql(metric: str) -> str:
    inner = f"(SELECT handset_type AS h, avg({metric}) AS v FROM exp GROUP BY handset_type)"
    return (f"(SELECT h AS hi_h, v AS hi_v FROM {inner} ORDER BY v DESC, h LIMIT 1), "
            f"(SELECT h AS lo_h, v AS lo_v FROM {inner} ORDER BY v, h LIMIT 1)")


query("throughput_gap", "best_handset worst_handset gap:r1", S.clean_experience(),
      "SELECT hi_h AS best_handset, lo_h AS worst_handset, CASE WHEN lo_v > 0 THEN "
      f"round(hi_v / lo_v, 1) ELSE CAST('inf' AS DOUBLE) END AS gap "
      f"FROM {ends_sql('avg_throughput_kbps')}")(
    lambda spark, d: ranking.throughput_gap(plan(spark, d, "experience").experience))
query("tcp_gap", "worst_handset best_handset gap:r1", S.clean_experience(),
      "SELECT hi_h AS worst_handset, lo_h AS best_handset, round(hi_v / greatest(lo_v, 1), 0) AS gap "
      f"FROM {ends_sql('avg_tcp_retransmission')}")(
    lambda spark, d: ranking.tcp_gap(plan(spark, d, "experience").experience))
query("experience_kpis", "users:long " + doubles(S.EXP, 4), S.clean_experience(),
      "SELECT count(*) AS users, " + ", ".join(f"avg({m}) AS {m}" for m in S.EXP) + " FROM exp")(
    lambda spark, d: reports.experience_kpis(plan(spark, d, "experience").experience))
query("experience_preview", "user_id:long " + doubles(S.EXP, 4) + " handset_type",
      S.clean_experience(), "SELECT * FROM exp ORDER BY user_id LIMIT 20")(
    lambda spark, d: reports.experience_preview(plan(spark, d, "experience").experience))

EXPC = S.experience_clusters()
query("experience_clusters", "user_id:long " + doubles(S.EXP, 4) + " experience_cluster:int",
      EXPC, "SELECT * FROM expc")(
    lambda spark, d: plan(spark, d, "experience").experience_clustered)


@query("experience_clusters_ml")
def _experience_clusters_ml(spark, d):
    return plan(spark, d, "experience", method="ml").experience_clustered


query("experience_restarts", COST_SPEC, EXPC,
      "SELECT 3 AS k, 10 AS starts, sum(d) AS rank_cost, true AS no_dearer FROM expc")(
    lambda spark, d: restart_costs(plan(spark, d, "experience").experience, EXPERIENCE_METRICS, [3],
                                   "standard"))


def experience_table(operator, *more):
    return lambda spark, d: operator(plan(spark, d, "experience").experience_clustered,
                                     "experience_cluster", *more)


def experience_report(operator):
    def run(spark, d):
        p = plan(spark, d, "experience")
        return operator(p.experience_clustered, p.experience_labels)
    return run


EXPSEG = [*EXPC, S.EXP_LABELS, S.statistics("expc", "experience_cluster", S.EXP, "st"),
          S.share("expc", "experience_cluster", S.EXP, "sh")]
_EJOINED = ("st JOIN sh USING (experience_cluster) JOIN expl USING (experience_cluster)")
query("experience_labels", "experience_cluster:int rank:int label", [*EXPC, S.EXP_LABELS],
      "SELECT * FROM expl")(experience_table(clustering.experience_labels))
query("experience_cluster_summary", "experience_cluster:int " + doubles(S.EXP, 4), EXPC,
      "SELECT experience_cluster, " + ", ".join(f"avg({m}) AS {m}" for m in S.EXP)
      + " FROM expc GROUP BY experience_cluster")(
    experience_table(clustering.cluster_means, EXPERIENCE_METRICS))
query("experience_cluster_stats",
      "experience_cluster:int " + " ".join(f"{m}_{n}:3" for m in S.EXP
                                           for n in ("min", "max", "mean", "sum")),
      EXPSEG, "SELECT * FROM st")(
    experience_table(clustering.cluster_statistics, EXPERIENCE_METRICS))
query("experience_cluster_share",
      "experience_cluster:int user_count:long " + " ".join(f"{m}_mean:4" for m in S.EXP)
      + " user_pct:6", EXPSEG, f"SELECT * FROM {_EJOINED}")(
    experience_table(clustering.cluster_distribution, EXPERIENCE_METRICS))
query("experience_boxes", f"experience_cluster:int metric {BOX_SPEC}", EXPC,
      "SELECT CAST(split_part(box, '|', 1) AS INTEGER) AS experience_cluster, "
      "split_part(box, '|', 2) AS metric, * FROM ("
      + S.boxes("(" + " UNION ALL ".join(
          f"SELECT experience_cluster || '|{m}' AS box, {m} AS value FROM expc" for m in S.EXP)
          + ")", "box") + ")")(
    experience_table(clustering.cluster_boxes, EXPERIENCE_METRICS))
query("experience_segments",
      "cluster classification users:long users_pct:r1 tcp_avg:r1 tcp_max:r1 rtt_avg:r1 "
      "rtt_max:r1 throughput_avg:r1 throughput_max:r1", EXPSEG,
      "SELECT 'Cluster ' || experience_cluster AS cluster, label AS classification, user_count AS "
      "users, user_pct AS users_pct, " + ", ".join(
          f"{m}_{s} AS {short}_{n}" for m, short in zip(S.EXP, ("tcp", "rtt", "throughput"))
          for s, n in (("mean", "avg"), ("max", "max"))) + f" FROM {_EJOINED}")(
    experience_report(reports.experience_segments))
query("experience_key_finding", "poor_user_pct:6 good_user_pct:6 tcp_gap:r0 throughput_gap:r1",
      EXPSEG,
      "SELECT p.user_pct AS poor_user_pct, g.user_pct AS good_user_pct, "
      "round(p.avg_tcp_retransmission_mean / greatest(g.avg_tcp_retransmission_mean, 1), 0) AS "
      "tcp_gap, round(g.avg_throughput_kbps_mean / greatest(p.avg_throughput_kbps_mean, 1), 1) AS "
      f"throughput_gap FROM (SELECT * FROM {_EJOINED} WHERE label = 'Poor') p, "
      f"(SELECT * FROM {_EJOINED} WHERE label = 'Good') g")(
    experience_report(reports.experience_key_finding))
query("experience_profile_long", "cluster label metric mean_value:4", EXPSEG,
      " UNION ALL ".join(f"SELECT experience_cluster || ' - ' || label AS cluster, label, '{m}' AS "
                         f"metric, {m}_mean AS mean_value FROM {_EJOINED}" for m in S.EXP))(
    experience_report(lambda users, labels: reports.means_long(
        users, labels, "experience_cluster", EXPERIENCE_METRICS)))

query("experience_cluster_histograms", f"variable experience_cluster:int {_HIST_SPEC}", EXPC,
      S.histograms(S.long_form(S.EXP, "expc", ["experience_cluster"]), 60, "experience_cluster"))(
    lambda spark, d: statistics.histogram(plan(spark, d, "experience").experience_clustered,
                                          EXPERIENCE_METRICS, 60, by="experience_cluster"))
query("user_metric_histograms", f"variable {_HIST_SPEC}", S.clean_experience(),
      S.histograms(S.long_form(S.EXP, "exp"), 80))(
    lambda spark, d: statistics.histogram(plan(spark, d, "experience").experience,
                                          EXPERIENCE_METRICS, 80))

# -- satisfaction ------------------------------------------------------------

query("engagement_score", "user_id:long engagement_cluster:int engagement_score:6",
      S.engagement_scores(), "SELECT * FROM engs")(
    lambda spark, d: scoring.engagement_score(plan(spark, d, "engagement").engagement_clustered))
query("experience_score", "user_id:long experience_cluster:int experience_score:6",
      S.experience_scores(), "SELECT * FROM exps")(
    lambda spark, d: scoring.experience_score(plan(spark, d, "experience").experience_clustered))

SCORE_SPEC = "engagement_score:6 experience_score:6 satisfaction_score:6"
SAT = S.satisfaction()
SATC = S.satisfaction_clusters()


def satisfaction_query(name: str, columns: str | None, final: str | None,
                       operator: Callable[[DataFrame], DataFrame],
                       ctes: Sequence[str] = ()) -> None:
    query(name, columns, [*SAT, *ctes] if final else (), final)(
        lambda spark, d: operator(plan(spark, d).satisfaction))


satisfaction_query("satisfaction_table", f"user_id:long {SCORE_SPEC}", "SELECT * FROM sat",
                   lambda t: t)
satisfaction_query("top10_satisfied", f"user_id:long {SCORE_SPEC}",
                   "SELECT * FROM sat ORDER BY satisfaction_score DESC, user_id LIMIT 10",
                   scoring.top_satisfied)
satisfaction_query("satisfaction_distribution", f"metric {BOX_SPEC}",
                   S.boxes("(SELECT 'satisfaction_score' AS metric, satisfaction_score AS value "
                           "FROM sat)", "metric"), reports.score_distribution)
satisfaction_query("satisfaction_density", "bin:int bin_start:4 bin_end:4 count:long density:6",
                   "SELECT *, count / sum(count) OVER () / (bin_end - bin_start) AS density FROM ("
                   + S.histograms(S.long_form(["satisfaction_score"], "sat"), 60) + ")",
                   reports.score_density)
satisfaction_query("score_space_grid",
                   "engagement_bin:int experience_bin:int users:long satisfaction_score:5",
                   "SELECT floor(log10(engagement_score) * 10) AS engagement_bin, "
                   "floor(log10(experience_score) * 10) AS experience_bin, count(*) AS users, "
                   "avg(satisfaction_score) AS satisfaction_score FROM sat "
                   "WHERE engagement_score > 0 AND experience_score > 0 GROUP BY 1, 2",
                   reports.score_space_grid)
satisfaction_query("default_inputs", "engagement_score:6 experience_score:6",
                   "SELECT avg(engagement_score) AS engagement_score, avg(experience_score) AS "
                   "experience_score FROM sat", reports.default_inputs)
query("satisfaction_clusters", f"user_id:long {SCORE_SPEC} satisfaction_cluster:int", SATC,
      "SELECT * FROM satc")(lambda spark, d: plan(spark, d).satisfaction_clustered)
query("satisfaction_restarts", COST_SPEC, SATC,
      "SELECT 2 AS k, 10 AS starts, sum(d) AS rank_cost, true AS no_dearer FROM satc")(
    lambda spark, d: restart_costs(plan(spark, d).satisfaction, scoring.SCORE_FEATURES, [2],
                                   "standard"))
MEANS = ("SELECT satisfaction_cluster, avg(engagement_score) AS engagement_score, "
         "avg(experience_score) AS experience_score, avg(satisfaction_score) AS satisfaction_score "
         "FROM satc GROUP BY satisfaction_cluster")
query("satisfaction_cluster_means", f"satisfaction_cluster:int {SCORE_SPEC}", SATC, MEANS)(
    lambda spark, d: scoring.satisfaction_cluster_means(plan(spark, d).satisfaction_clustered))


@query("satisfaction_labels", f"satisfaction_cluster:int {SCORE_SPEC} label insight", SATC,
       "SELECT t.*, insight FROM (SELECT *, CASE row_number() OVER (ORDER BY satisfaction_score) "
       f"WHEN 1 THEN 'Low Satisfaction Users' ELSE 'High Satisfaction Users' END AS label FROM "
       f"({MEANS})) t JOIN (VALUES {S.INSIGHTS}) v(label, insight) USING (label)")
def _satisfaction_labels(spark, d):
    p = plan(spark, d)
    return scoring.describe_satisfaction(p.satisfaction_clustered, p.satisfaction_segmentation)


@query("export_scores", f"customer_id:long {SCORE_SPEC}", SAT,
       "SELECT user_id AS customer_id, * FROM sat")
def _export_scores(spark, d):
    table = scoring.score_export(plan(spark, d).satisfaction)
    name = f"user_scores_{uuid.uuid4().hex}"
    tables.export_table(table, name, path=scratch_path(spark, "user_scores"))
    return tables.read_table(spark, name)


def report(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Run report SQL over the exported, clustered satisfaction table."""
    clustered = plan(spark, d).satisfaction_clustered
    name = f"user_satisfaction_{uuid.uuid4().hex}"
    tables.export_table(clustered, name, path=scratch_path(spark, "user_satisfaction"))
    return tables.run_query(spark, text.replace("user_satisfaction", name))


PREVIEW = "SELECT * FROM user_satisfaction ORDER BY user_id LIMIT 10"
TOP_SQL = "SELECT * FROM user_satisfaction ORDER BY satisfaction_score DESC, user_id LIMIT 10"
DISTRIBUTION = ("SELECT satisfaction_cluster, COUNT(*) AS user_count, AVG(satisfaction_score) AS "
                "avg_score FROM user_satisfaction GROUP BY satisfaction_cluster "
                "ORDER BY avg_score DESC")
for _name, _columns, _text in (
        ("report_preview", f"user_id:long {SCORE_SPEC} satisfaction_cluster:int", PREVIEW),
        ("report_top10", f"user_id:long {SCORE_SPEC} satisfaction_cluster:int", TOP_SQL),
        ("report_cluster_distribution", "satisfaction_cluster:int user_count:long avg_score:6",
         DISTRIBUTION)):
    query(_name, _columns, [*SATC, "user_satisfaction AS (SELECT user_id, engagement_score, "
                            "experience_score, satisfaction_score, satisfaction_cluster FROM satc)"],
          _text)(partial(lambda text, spark, d: report(spark, d, text), _text))

# -- the whole job -----------------------------------------------------------

@query("analysis_job", f"user_id:long {SCORE_SPEC} satisfaction_cluster:int", SATC,
       "SELECT * FROM satc")
def _analysis_job(spark, d):
    """Raw sessions to stored tables, models, runs and export; the job's satisfaction table."""
    paths = job.run_analysis(joined_once(spark, d), scratch_path(spark, "job"), method="lloyd",
                             candidates=("ridge",), export_name=f"user_scores_{uuid.uuid4().hex}")
    return files.load_feature(spark, paths["satisfaction"])


@query("export_job", f"customer_id:long {SCORE_SPEC}", SAT,
       "SELECT user_id AS customer_id, * FROM sat ORDER BY user_id LIMIT 5")
def _export_job(spark, d):
    """What the export job reads back from the table it has written."""
    rows = job.export_scores(plan(spark, d).satisfaction, f"user_scores_{uuid.uuid4().hex}",
                             path=scratch_path(spark, "user_scores"))
    return spark.createDataFrame(rows, "customer_id long, engagement_score double, "
                                       "experience_score double, satisfaction_score double")


#: Sessions without a user become those of one user with the mean id.
_MEAN_IDS = [c.replace("SELECT *,", "SELECT * REPLACE (coalesce(user_id, (SELECT trunc(avg(user_id)) FROM "
                       "raw)) AS user_id),", 1) if c.startswith("s AS") else c for c in SAT]


@query("satisfaction_mean_ids", f"user_id:long {SCORE_SPEC}", _MEAN_IDS, "SELECT * FROM sat")
def _satisfaction_mean_ids(spark, d):
    return UsagePlan(joined_once(spark, d), parts=("engagement", "experience"), method="lloyd",
                     id_policy="mean").satisfaction


# -- models ------------------------------------------------------------------

satisfaction_query("train_test_split", "user_id:long is_test:int",
                   f"SELECT user_id, CAST({S.IS_TEST} AS INTEGER) AS is_test FROM sat",
                   lambda t: (lambda a, b: a.withColumn("is_test", F.lit(0)).unionByName(
                       b.withColumn("is_test", F.lit(1))))(*models.train_test_split(t, "user_id")))

TRAIN = [f"tr AS MATERIALIZED (SELECT * FROM sat WHERE NOT {S.IS_TEST})",
         f"te AS MATERIALIZED (SELECT * FROM sat WHERE {S.IS_TEST})", S.ridge("tr", "w")]
PREDICTED = "(b0 + be * engagement_score + bx * experience_score)"


def trained_ridge(table: DataFrame) -> tuple[models.RidgeModel, DataFrame]:
    training, test = models.train_test_split(table, "user_id")
    return models.fit_model(training, "ridge"), test


satisfaction_query("train_ridge", "term weight:8",
                   "SELECT 'engagement_score' AS term, be AS weight FROM w UNION ALL "
                   "SELECT 'experience_score', bx FROM w UNION ALL SELECT 'intercept', b0 FROM w",
                   lambda t: trained_ridge(t)[0].as_table(t), TRAIN)
satisfaction_query("regression_metrics", "rows:long mse:9 rmse:7 mae:7 r2:7",
                   "SELECT count(*) AS rows, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, "
                   "avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2 FROM (SELECT "
                   f"satisfaction_score AS y, satisfaction_score - {PREDICTED} AS e FROM te, w)",
                   lambda t: (lambda m, test: models.regression_metrics(models.score(test, m)))(
                       *trained_ridge(t)), TRAIN)
satisfaction_query("score_users", f"user_id:long {SCORE_SPEC} predicted_satisfaction:6",
                   f"SELECT sat.*, {PREDICTED} AS predicted_satisfaction FROM sat, w",
                   lambda t: _stored_ridge_scores(t), TRAIN)


def _stored_ridge_scores(t: DataFrame) -> DataFrame:
    """Train, store, load and score, as separate jobs would."""
    path = scratch_path(t.sparkSession, "ridge")
    models.save_model(t, trained_ridge(t)[0], path)
    return models.score_or_average(t, path)


satisfaction_query("fallback_score", f"user_id:long {SCORE_SPEC} predicted_satisfaction:6",
                   "SELECT *, (engagement_score + experience_score) / 2 AS predicted_satisfaction "
                   "FROM sat",
                   lambda t: models.score_or_average(t, scratch_path(t.sparkSession, "absent")))
satisfaction_query("cv_folds", "user_id:long fold:int",
                   "SELECT user_id, ntile(5) OVER (ORDER BY user_id) - 1 AS fold FROM sat",
                   lambda t: models.with_fold(t, "user_id"))
satisfaction_query("ridge_cv", "fold:int rows:long rmse:7",
                   "SELECT fold, count(*) AS rows, sqrt(avg(e * e)) AS rmse FROM (SELECT fo.fold, "
                   f"satisfaction_score - {PREDICTED} AS e FROM fo JOIN w ON fo.fold = w.left_out) "
                   "GROUP BY fold", lambda t: models.ridge_cv(t, "user_id"),
                   ["fo AS MATERIALIZED (SELECT *, CAST(ntile(5) OVER (ORDER BY user_id) - 1 AS "
                    "INTEGER) AS fold FROM sat)",
                    "folds AS (SELECT fo.*, CAST(i AS INTEGER) AS left_out FROM fo, range(5) t(i) "
                    "WHERE i <> fo.fold)", S.ridge("folds", "w", "left_out")])


def run_record(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda t: models.train(t, name)[1]


#: A boosted model small enough for its twin to grow the same trees.
SMALL = {"n_estimators": 4, "learning_rate": 0.3, "max_depth": 2, "bins": 12}
_HELD_OUT = S.boosted(list(scoring.SCORE_FEATURES), models.TARGET, ["NOT is_test"], 4, 2, 12, 0.3)
_FOLD_MODELS = S.boosted(list(scoring.SCORE_FEATURES), models.TARGET, [f"fold <> {i}" for i in range(5)],
                         4, 2, 12, 0.3)


def small_boosted(t: DataFrame) -> models.Boosted:
    settings = {**models.CANDIDATES["gradient_boosting"], **SMALL}
    return models.boosted_hold_out(t, "user_id", scoring.SCORE_FEATURES, models.TARGET, settings,
                                   with_cv=False)[0]


def _stored_tree_scores(t: DataFrame) -> DataFrame:
    """Train, store the nodes, load them and score by the expression they stand for."""
    path = scratch_path(t.sparkSession, "boosted")
    models.save_model(t, small_boosted(t), path)
    return models.score_or_average(t, path)


satisfaction_query("gbt_nodes", "tree:int node:int feature threshold:6 value:6",
                   "SELECT * FROM gnodes",
                   lambda t: small_boosted(t).as_table(t.sparkSession), [S.FOLDED, *_HELD_OUT])
satisfaction_query("score_users_gbt", f"user_id:long {SCORE_SPEC} predicted_satisfaction:6",
                   "SELECT sat.*, f AS predicted_satisfaction FROM sat JOIN gm4 USING (user_id)",
                   _stored_tree_scores, [S.FOLDED, *_HELD_OUT])
satisfaction_query("gbt_cv_small", "fold:int rows:long rmse:7",
                   "SELECT m AS fold, count(*) AS rows, sqrt(avg((y - f) * (y - f))) AS rmse FROM gm4 "
                   "WHERE NOT trains GROUP BY m",
                   lambda t: models.cross_validate(t, "user_id", "gradient_boosting", params=SMALL),
                   [S.FOLDED, *_FOLD_MODELS])
satisfaction_query("train_gbt", None, None, run_record("gradient_boosting"))
satisfaction_query("train_rf", None, None, run_record("random_forest"))
satisfaction_query("satisfaction_model", None, None,
                   lambda t: models.train(t, "gradient_boosting", with_cv=False)[1].select(
                       "mse", "rmse", "r2", "train_duration_sec", "run_id"))
satisfaction_query("gbt_cv", None, None,
                   lambda t: models.cross_validate(t, "user_id", "gradient_boosting"))
satisfaction_query("rf_cv", None, None,
                   lambda t: models.cross_validate(t, "user_id", "random_forest"))
satisfaction_query("model_comparison", None, None, lambda t: models.train_all(t))


def _logged_runs(t: DataFrame) -> DataFrame:
    path = scratch_path(t.sparkSession, "runs")
    for name in models.CANDIDATES:
        models.append_run(models.train(t, name)[1], path)
    return t.sparkSession.read.parquet(path)


satisfaction_query("model_runs", None, None, _logged_runs)
