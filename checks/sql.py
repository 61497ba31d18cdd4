"""SQL building blocks: the analysis restated as CTE chains for another engine.

Nothing here uses the package: column lists and rules are written out again so
that a comparison checks two independent statements of the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

APPS = ("social_media", "google", "email", "youtube", "netflix", "gaming", "other")
APP_COLUMNS = [f"{a}_{w}" for a in APPS for w in ("dl", "ul")]
QUALITY = ["rtt_dl_ms", "rtt_ul_ms", "tp_dl_kbps", "tp_ul_kbps", "tcp_dl_bytes", "tcp_ul_bytes"]
VOLUMES = ["dur_ms", "total_dl", "total_ul"]
VIEW_APPS = [f"{a}_dl" for a in APPS] + [f"{a}_ul" for a in APPS]
MEASURES = ["dur_ms", *QUALITY, *VIEW_APPS, "total_dl", "total_ul"]
ENG = ["sessions_frequency", "total_duration_ms", "total_traffic_bytes"]
EXP = ["avg_tcp_retransmission", "avg_rtt_ms", "avg_throughput_kbps"]

_VOLUME = ",\n".join(
    f"l.l_extendedprice * ((l.l_partkey * {i} + l.l_suppkey) % {m}) AS {a}_{w}"
    for w, m in (("dl", 97), ("ul", 11)) for i, a in enumerate(APPS, 1))

SESSIONS = f"""s AS MATERIALIZED (
SELECT l.l_orderkey * 10 + l.l_linenumber AS bearer_id,
  CASE WHEN l.l_orderkey % 61 = 0 THEN NULL ELSE o.o_custkey END AS user_id,
  l.l_shipdate AS start_ts,
  CASE WHEN l.l_orderkey % 37 = 0 THEN NULL ELSE p.p_brand END AS handset_manufacturer,
  CASE WHEN l.l_orderkey % 41 = 0 THEN NULL ELSE p.p_name END AS handset_type,
  CASE WHEN l.l_orderkey % 53 = 0 THEN NULL WHEN l.l_orderkey % 59 = 0
       THEN l.l_quantity * 1500000 ELSE l.l_quantity * 60000 END AS dur_ms,
  CASE WHEN l.l_suppkey % 10 = 0 THEN NULL
       ELSE CAST(5 + l.l_partkey % 196 AS DOUBLE) END AS rtt_dl_ms,
  CAST(5 + l.l_suppkey % 97 AS DOUBLE) AS rtt_ul_ms,
  l.l_extendedprice / l.l_quantity AS tp_dl_kbps,
  l.l_extendedprice / l.l_quantity / 10 AS tp_ul_kbps,
  CASE WHEN l.l_partkey % 10 = 3 THEN NULL
       WHEN l.l_orderkey % 50 = 0 THEN l.l_extendedprice * 20
       ELSE l.l_extendedprice * l.l_tax END AS tcp_dl_bytes,
  l.l_extendedprice * l.l_tax / 2 AS tcp_ul_bytes,
  {_VOLUME},
  CASE WHEN l.l_orderkey % 67 = 0 THEN l.l_extendedprice * 30000
       ELSE l.l_extendedprice * 1000 END AS total_dl,
  l.l_extendedprice * 100 * (1 + l.l_discount) AS total_ul
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey)"""


def _join(parts: Sequence[str]) -> str:
    return ", ".join(parts)


def imputed(columns: Sequence[str], keep: Sequence[str] = (), texts: Sequence[str] = (),
            source: str = "s") -> list[str]:
    modes = [f"(SELECT {t} FROM {source} WHERE {t} IS NOT NULL GROUP BY {t} "
             f"ORDER BY count(*) DESC, {t} LIMIT 1) AS {t}" for t in texts]
    means = (f"m AS MATERIALIZED (SELECT {_join([f'avg({c}) AS {c}' for c in columns] + modes)} "
             f"FROM {source})")
    filled = [f"coalesce(t.{c}, m.{c}) AS {c}" for c in [*texts, *columns]]
    return [means, f"i AS MATERIALIZED (SELECT {_join([f't.{k}' for k in keep] + filled)} "
                   f"FROM {source} t, m)"]


def fenced(columns: Sequence[str], keep: Sequence[str], source: str = "i") -> list[str]:
    quartiles = _join([f"quantile_cont({c}, {p}) AS {c}_{n}" for c in columns
                       for p, n in ((0.25, "q1"), (0.75, "q3"))])
    ends = _join([e for c in columns for e in (
        f"{c}_q1 - 1.5 * ({c}_q3 - {c}_q1) AS {c}_lo", f"{c}_q3 + 1.5 * ({c}_q3 - {c}_q1) AS {c}_hi")])
    inliers = _join([f"avg(CASE WHEN {c} >= {c}_lo AND {c} <= {c}_hi THEN {c} END) AS {c}_in"
                     for c in columns])
    fixed = [f"CASE WHEN {c} < {c}_lo OR {c} > {c}_hi THEN {c}_in ELSE {c} END AS {c}"
             for c in columns]
    return [f"q AS MATERIALIZED (SELECT {quartiles} FROM {source})",
            f"f AS MATERIALIZED (SELECT {ends} FROM q)",
            f"b AS MATERIALIZED (SELECT {inliers} FROM {source}, f)",
            f"c AS MATERIALIZED (SELECT {_join([*keep, *fixed])} FROM {source}, f, b)"]


#: The session view cleaned, under the name ``s``.
CLEANED = [SESSIONS.replace("s AS MATERIALIZED", "raw AS MATERIALIZED", 1),
           *imputed(MEASURES, ["bearer_id", "user_id", "start_ts"],
                    ["handset_manufacturer", "handset_type"], "raw"),
           *fenced(MEASURES, ["bearer_id", "user_id", "start_ts", "handset_manufacturer",
                              "handset_type"]),
           "s AS MATERIALIZED (SELECT *, total_dl + total_ul AS total_data FROM c)"]


def unique(ctes: Sequence[str]) -> list[str]:
    """Each CTE once, at its first place."""
    found: dict[str, str] = {}
    for c in ctes:
        found.setdefault(c.split(" AS ", 1)[0], c)
    return list(found.values())


def engagement(source: str = "s") -> str:
    return f"""eng AS MATERIALIZED (SELECT user_id, count(dur_ms) AS sessions_frequency,
 sum(dur_ms) AS total_duration_ms, sum(total_dl) AS total_dl_bytes, sum(total_ul) AS total_ul_bytes,
 sum(total_dl) + sum(total_ul) AS total_traffic_bytes FROM {source} WHERE user_id IS NOT NULL
 GROUP BY user_id)"""


def traffic(source: str = "s") -> str:
    sums = _join([f"sum(coalesce({a}_dl, 0) + coalesce({a}_ul, 0)) AS {a}_total_bytes" for a in APPS])
    return f"app AS MATERIALIZED (SELECT user_id, {sums} FROM {source} WHERE user_id IS NOT NULL GROUP BY user_id)"


MODAL = """modal AS (SELECT user_id, handset_type FROM (SELECT user_id, handset_type,
 row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, handset_type) AS rn
 FROM {source} WHERE handset_type IS NOT NULL AND user_id IS NOT NULL
 GROUP BY user_id, handset_type) WHERE rn = 1)"""


def experience(source: str = "s", name: str = "exp", digits: int | None = None) -> list[str]:
    """Per-user quality; ``digits`` rounds the combined metrics."""
    def r(e: str) -> str:
        return f"round({e}, {digits})" if digits is not None else e
    return [MODAL.format(source=source), f"""{name} AS MATERIALIZED (SELECT a.user_id,
 tcp_dl AS avg_tcp_dl_retrans, tcp_ul AS avg_tcp_ul_retrans, rtt_dl AS avg_rtt_dl_ms,
 rtt_ul AS avg_rtt_ul_ms, tp_dl AS avg_throughput_dl_kbps, tp_ul AS avg_throughput_ul_kbps,
 {r('(tcp_dl + tcp_ul) / 2')} AS avg_tcp_retransmission, {r('(rtt_dl + rtt_ul) / 2')} AS avg_rtt_ms,
 {r('(tp_dl + tp_ul) / 2')} AS avg_throughput_kbps,
 coalesce(modal.handset_type, 'Unknown') AS handset_type
 FROM (SELECT user_id, avg(tcp_dl_bytes) AS tcp_dl, avg(tcp_ul_bytes) AS tcp_ul,
  avg(rtt_dl_ms) AS rtt_dl, avg(rtt_ul_ms) AS rtt_ul, avg(tp_dl_kbps) AS tp_dl,
  avg(tp_ul_kbps) AS tp_ul FROM {source} WHERE user_id IS NOT NULL GROUP BY user_id) a
 LEFT JOIN modal ON a.user_id = modal.user_id)"""]


def clean_experience(digits: int | None = None) -> list[str]:
    return [*CLEANED, *experience("s", digits=digits)]


def overview() -> str:
    sums = _join([f"sum({c}) AS {c}_sum" for c in APP_COLUMNS])
    return f"""ov AS MATERIALIZED (SELECT user_id, count(dur_ms) AS sessions_count,
 sum(dur_ms) AS total_duration_ms, sum(total_dl) AS total_dl_bytes, sum(total_ul) AS total_ul_bytes,
 sum(total_dl + total_ul) AS total_data_bytes, {sums} FROM s WHERE user_id IS NOT NULL
 GROUP BY user_id)"""


def last_handset() -> list[str]:
    order = ("start_ts DESC NULLS LAST, bearer_id DESC NULLS LAST, handset_type DESC NULLS LAST, "
             "handset_manufacturer DESC NULLS LAST, total_dl DESC NULLS LAST")
    return [f"last_{c} AS (SELECT user_id, {c} FROM (SELECT user_id, {c}, row_number() OVER "
            f"(PARTITION BY user_id ORDER BY {order}) AS rn FROM s WHERE {c} IS NOT NULL AND user_id IS NOT NULL) WHERE rn = 1)"
            for c in ("handset_manufacturer", "handset_type")]


def scaled(source: str, features: Sequence[str], kind: str, name: str) -> str:
    """Source plus scaled features x0, x1, ...; constants scale to zero."""
    filled = [f"coalesce(CAST({f} AS DOUBLE), 0)" for f in features]
    if kind == "minmax":
        stats = [(f"min({e})", f"max({e}) - min({e})") for e in filled]
    else:
        stats = [(f"avg({e})", f"stddev_pop({e})") for e in filled]
    numbers = _join([f"{a} AS a{i}, CASE WHEN {w} = 0 THEN 1 ELSE {w} END AS w{i}"
                     for i, (a, w) in enumerate(stats)])
    xs = _join([f"({e} - a{i}) / w{i} AS x{i}" for i, e in enumerate(filled)])
    return (f"{name} AS MATERIALIZED (SELECT {source}.*, {xs} FROM {source}, "
            f"(SELECT {numbers} FROM {source}))")


#: Lloyd iterations of the twin: far more than a fit on the check data needs to stand still.
STEPS = 250


def lloyd(source: str, features: Sequence[str], kind: str, k: int, out: str,
          cluster: str | None = None) -> list[str]:
    """Recursive Lloyd iterations; ``out`` = source columns + scaled features + cluster.

    A step keeps the centroids as one row of lists; once they move by less than rounding the
    recursion ends.
    """
    xs = [f"x{i}" for i in range(len(features))]
    z, p = f"{out}_z", out
    ctes = [scaled(source, features, kind, z)]
    ctes.append(f"{p}_r AS (SELECT {_join(xs)}, row_number() OVER (ORDER BY "
                f"coalesce(CAST({features[0]} AS DOUBLE), 0), user_id) AS rn, "
                f"count(*) OVER () AS n FROM {z})")
    ctes.append(f"{p}_c0 AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS cl, {_join(xs)} FROM "
                f"range({k}) t(i) JOIN {p}_r ON rn = (n * (2 * i + 1) + {2 * k - 1}) // {2 * k})")

    def distance(c: str) -> str:
        return " + ".join(f"({z}.{x} - {c}.{x}) * ({z}.{x} - {c}.{x})" for x in xs)

    own = _join([f"c.{x} AS c_{x}" for x in xs])
    means = _join([f"coalesce(avg({x}) FILTER (WHERE pick = 1), any_value(c_{x})) AS {x}"
                   for x in xs])
    moved = " + ".join(f"abs(avg({x}) FILTER (WHERE pick = 1) - any_value(c_{x}))" for x in xs)
    ctes.append(
        f"{p}_it AS (SELECT 0 AS step, cl, {_join(xs)}, CAST(1 AS DOUBLE) AS moved FROM {p}_c0 "
        f"UNION ALL SELECT step, cl, {_join(xs)}, sum(coalesce(moved, 0)) OVER () AS moved FROM ("
        f"SELECT step + 1 AS step, cl, {means}, {moved} AS moved FROM (SELECT c.step, c.cl, {own}, "
        f"{_join([f'{z}.{x}' for x in xs])}, row_number() OVER (PARTITION BY {z}.user_id ORDER BY "
        f"{distance('c')}, c.cl) AS pick FROM {p}_it c, {z} WHERE c.moved > 1e-11 "
        f"AND c.step < {STEPS}) GROUP BY step, cl))")
    ctes.append(f"{p}_end AS MATERIALIZED (SELECT * FROM {p}_it "
                f"WHERE step = (SELECT max(step) FROM {p}_it))")
    ctes.append(f"{out} AS MATERIALIZED (SELECT *, cl AS {cluster or 'cluster'} FROM (SELECT {z}.*, "
                f"c.cl, {distance('c')} AS d, row_number() OVER (PARTITION BY {z}.user_id ORDER BY "
                f"{distance('c')}, c.cl) AS pick FROM {z}, {p}_end c) WHERE pick = 1)")
    return ctes


def engagement_clusters() -> list[str]:
    return [*CLEANED, engagement("s"),
            *lloyd("eng", ENG, "minmax", 3, "engc", "engagement_cluster")]


def experience_clusters() -> list[str]:
    return [*clean_experience(), *lloyd("exp", EXP, "standard", 3, "expc", "experience_cluster")]


def labels(source: str, cluster: str, score: str, names: Sequence[str], out: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, 1))
    return (f"{out} AS MATERIALIZED (SELECT {cluster}, rank, CASE rank {whens} END AS label FROM "
            f"(SELECT {cluster}, row_number() OVER (ORDER BY {score}, {cluster}) AS rank "
            f"FROM {source} GROUP BY {cluster}))")


ENG_LABELS = labels("engc", "engagement_cluster",
                    "(avg(sessions_frequency) + avg(total_duration_ms) + avg(total_traffic_bytes)) / 3",
                    ("Low", "Medium", "High"), "engl")
EXP_LABELS = labels("expc", "experience_cluster", "avg(avg_tcp_retransmission)",
                    ("Good", "Average", "Poor"), "expl")


def statistics(source: str, cluster: str, metrics: Sequence[str], out: str) -> str:
    columns = _join([f"{f}({m}) AS {m}_{n}" for m in metrics for f, n in
                     (("min", "min"), ("max", "max"), ("avg", "mean"), ("sum", "sum"))])
    return f"{out} AS (SELECT {cluster}, {columns} FROM {source} GROUP BY {cluster})"


def share(source: str, cluster: str, metrics: Sequence[str], out: str) -> str:
    totals = _join([f"sum({m}) AS {m}_total" for m in metrics])
    pct = _join([f"100.0 * {c} / sum({c}) OVER () AS {n}_pct" for c, n in
                 [("user_count", "user"), *[(f"{m}_total", m) for m in metrics]]])
    return (f"{out} AS (SELECT *, {pct} FROM (SELECT {cluster}, count(*) AS user_count, {totals} "
            f"FROM {source} GROUP BY {cluster}))")


def score(source: str, cluster: str, metrics: Sequence[str], pick: str, column: str,
          out: str) -> list[str]:
    """Distance in standard-scaled space to the centroid of the picked cluster."""
    z = f"{out}_z"
    means = _join([f"avg({m}) AS m{i}" for i, m in enumerate(metrics)])
    stats = _join([f"avg(coalesce({m}, 0)) AS a{i}, stddev_pop(coalesce({m}, 0)) AS w{i}"
                   for i, m in enumerate(metrics)])
    total = " + ".join(f"power((coalesce({m}, 0) - a{i}) / w{i} - (m{i} - a{i}) / w{i}, 2)"
                       for i, m in enumerate(metrics))
    return [f"{z} AS (SELECT {means} FROM {source} GROUP BY {cluster} ORDER BY {pick}, {cluster} LIMIT 1)",
            f"{out} AS MATERIALIZED (SELECT {source}.*, sqrt({total}) AS {column} FROM {source}, {z}, "
            f"(SELECT {stats} FROM {source}))"]


def engagement_scores() -> list[str]:
    return [*engagement_clusters(), *score("engc", "engagement_cluster", ENG,
            "avg(total_traffic_bytes)", "engagement_score", "engs")]


def experience_scores() -> list[str]:
    return [*experience_clusters(), *score("expc", "experience_cluster", EXP,
            "avg(avg_tcp_retransmission) DESC", "experience_score", "exps")]


def satisfaction() -> list[str]:
    return [*unique([*experience_scores(), *engagement_scores()]),
            "sat AS MATERIALIZED (SELECT engs.user_id, engagement_score, experience_score, "
            "(engagement_score + experience_score) / 2 AS satisfaction_score "
            "FROM engs JOIN exps ON engs.user_id = exps.user_id)"]


def satisfaction_clusters() -> list[str]:
    return [*satisfaction(), *lloyd("sat", ["engagement_score", "experience_score"], "standard", 2,
                                    "satc", "satisfaction_cluster")]


IS_TEST = "(CAST('0x' || substr(md5(user_id || '-42'), 1, 8) AS BIGINT) % 100) < 20"


def ridge(source: str, out: str, by: str = "") -> str:
    """Closed form for two features from counts, means and covariances."""
    e, x, y = "engagement_score", "experience_score", "satisfaction_score"
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""{out} AS MATERIALIZED (SELECT {lead}be, bx, ay - be * ae - bx * ax AS b0 FROM (
 SELECT *, (gxx * gey - gex * gxy) / (gee * gxx - gex * gex) AS be,
  (gee * gxy - gex * gey) / (gee * gxx - gex * gex) AS bx FROM (
 SELECT {lead}avg({e}) AS ae, avg({x}) AS ax, avg({y}) AS ay,
  covar_samp({e}, {e}) * (count(*) - 1) + 1.0 AS gee, covar_samp({x}, {x}) * (count(*) - 1) + 1.0 AS gxx,
  covar_samp({e}, {x}) * (count(*) - 1) AS gex, covar_samp({e}, {y}) * (count(*) - 1) AS gey,
  covar_samp({x}, {y}) * (count(*) - 1) AS gxy FROM {source}{group})))"""


#: Users with their fold and whether they are held out.
FOLDED = ("fo AS MATERIALIZED (SELECT *, CAST(ntile(5) OVER (ORDER BY user_id) - 1 AS INTEGER) AS "
          f"fold, {IS_TEST} AS is_test FROM sat)")


def boosted(features: Sequence[str], target: str, members: Sequence[str], trees: int, depth: int,
            bins: int, rate: float, source: str = "fo") -> list[str]:
    """Boosted trees, one model per training condition: ``gm{trees}`` has a row per user and model
    ``m`` with the prediction ``f``, ``gnodes`` the nodes of all models."""
    fs = range(len(features))
    ctes = [f"gr AS MATERIALIZED (SELECT *, count(*) OVER () AS n, " + _join(
        [f"row_number() OVER (ORDER BY {x}, user_id) AS r{i}" for i, x in enumerate(features)])
        + f" FROM {source})"]
    for i, x in enumerate(features):
        ctes.append(f"ge{i} AS MATERIALIZED (SELECT list(v ORDER BY v) AS e FROM (SELECT DISTINCT {x} AS v "
                    f"FROM gr, range(1, {bins}) t(i) WHERE r{i} = (n * i + {bins - 1}) // {bins}))")
    binned = _join([f"len([v for v in ge{i}.e if v < {x}]) AS b{i}" for i, x in enumerate(features)])
    trains = " ".join(f"WHEN {m} THEN {c}" for m, c in enumerate(members))
    ctes += [f"gb AS MATERIALIZED (SELECT gr.user_id, {target} AS y, m, CASE m {trains} END AS trains, "
             f"{binned} FROM gr, {_join([f'ge{i}' for i in fs])}, range({len(members)}) t(m))",
             "gm0 AS MATERIALIZED (SELECT *, avg(y) FILTER (WHERE trains) OVER (PARTITION BY m) AS f FROM gb)"]
    nodes = ["SELECT m, -1 AS tree, 1 AS node, NULL AS ft, NULL AS threshold, any_value(f) AS value FROM gm0 "
             "GROUP BY m"]
    for t in range(trees):
        ctes.append(f"gn{t}_0 AS MATERIALIZED (SELECT *, 1 AS node, y - f AS r FROM gm{t})")
        for level in range(depth):
            now = f"gn{t}_{level}"
            sides = " UNION ALL ".join(f"SELECT m, node, r, {i} AS ft, b{i} AS b FROM {now} WHERE trains "
                                       f"AND node >= {2 ** level}" for i in fs)
            pick = "CASE ft " + " ".join(f"WHEN {i} THEN b{i}" for i in fs) + " END"
            ctes += [
                f"gh{t}_{level} AS MATERIALIZED (SELECT m, node, ft, cut, count(*) FILTER (WHERE b <= cut) AS "
                f"nl, sum(r) FILTER (WHERE b <= cut) AS sl, count(*) AS n, sum(r) AS s FROM ({sides}), "
                f"range({bins - 1}) c(cut) GROUP BY m, node, ft, cut)",
                f"gs{t}_{level} AS MATERIALIZED (SELECT m, node, ft, cut FROM (SELECT *, row_number() OVER "
                "(PARTITION BY m, node ORDER BY ft, cut) AS pick FROM (SELECT *, max(g) OVER w AS top, "
                "max(p) OVER w AS most FROM (SELECT *, p - s * s / n AS g FROM (SELECT *, sl * sl / nl + "
                f"(s - sl) * (s - sl) / (n - nl) AS p FROM gh{t}_{level} WHERE nl > 0 AND nl < n)) WINDOW w AS "
                "(PARTITION BY m, node)) WHERE top > 1e-12 * most AND g >= top * (1 - 1e-9)) WHERE pick = 1)",
                f"gn{t}_{level + 1} AS MATERIALIZED (SELECT * EXCLUDE (node, ft, cut), CASE WHEN ft IS NULL "
                f"THEN node WHEN {pick} > cut THEN 2 * node + 1 ELSE 2 * node END AS node FROM {now} "
                f"LEFT JOIN gs{t}_{level} USING (m, node))"]
            edges = " ".join(f"WHEN {i} THEN (SELECT e[cut + 1] FROM ge{i})" for i in fs)
            nodes.append(f"SELECT m, {t}, node, ft, CASE ft {edges} END, NULL FROM gs{t}_{level}")
        ctes += [f"gl{t} AS MATERIALIZED (SELECT m, node, {rate} * avg(r) FILTER (WHERE trains) AS v "
                 f"FROM gn{t}_{depth} GROUP BY m, node)",
                 f"gm{t + 1} AS MATERIALIZED (SELECT * EXCLUDE (f, node, r, v), f + v AS f FROM gn{t}_{depth} "
                 f"JOIN gl{t} USING (m, node))"]
        nodes.append(f"SELECT m, {t}, node, NULL, NULL, v FROM gl{t}")
    names = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(features))
    return [*ctes, "gnodes AS MATERIALIZED (SELECT m AS model, tree, node, CASE ft " + names
            + " END AS feature, threshold, value FROM (" + " UNION ALL ".join(nodes) + "))"]


def long_form(columns: Sequence[str], source: str = "s", keep: Sequence[str] = (),
              variable: str = "variable") -> str:
    return " UNION ALL ".join(
        f"SELECT {''.join(k + ', ' for k in keep)}'{c}' AS {variable}, CAST({c} AS DOUBLE) AS value "
        f"FROM {source}" for c in columns)


def boxes(source: str, group: str, value: str = "value") -> str:
    """Box statistics per group of ``source``."""
    return f"""WITH src AS (SELECT {group}, {value} AS v FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL),
 qs AS (SELECT {group}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3 FROM src GROUP BY {group}),
 t AS (SELECT src.{group}, v, q1, median, q3,
  v >= q1 - (q3 - q1) * 1.5 AND v <= q3 + (q3 - q1) * 1.5 AS ok FROM src JOIN qs ON src.{group} = qs.{group})
 SELECT {group}, count(*) AS count, avg(v) AS mean, min(v) AS min,
  min(CASE WHEN ok THEN v END) AS whisker_low, q1, median, q3,
  max(CASE WHEN ok THEN v END) AS whisker_high, max(v) AS max,
  count(CASE WHEN NOT ok THEN 1 END) AS outliers FROM t GROUP BY {group}, q1, median, q3"""


def bins(value: str, low: str, high: str, n: int) -> str:
    return (f"CAST(least(floor(({value} - {low}) / ({high} - {low}) * {n}), {n - 1}) AS INTEGER)")


def histograms(long: str, n: int, by: str | None = None) -> str:
    """Counts per (variable, bin) of a long table, empty bins kept."""
    keep = f"{by}, " if by else ""
    groups = (f", (SELECT DISTINCT variable AS gv, {by} FROM l) g" if by else "")
    match = f" AND k.{by} IS NOT DISTINCT FROM g.{by}" if by else ""
    picked = f"g.{by}, " if by else ""
    where = " WHERE g.gv = r.variable" if by else ""
    inner = f"(SELECT r.*, t.i{', g.' + by if by else ''} FROM r, range({n}) t(i){groups}{where})"
    if by:
        match, picked = f" AND k.{by} IS NOT DISTINCT FROM f.{by}", f"f.{by}, "
    return f"""WITH l AS (SELECT * FROM ({long}) WHERE value IS NOT NULL),
 r AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM l GROUP BY variable),
 k AS (SELECT l.variable, {keep}{bins('value', 'lo', 'hi', n)} AS bin, count(*) AS n
  FROM l JOIN r ON l.variable = r.variable GROUP BY ALL)
 SELECT f.variable, {picked}CAST(f.i AS INTEGER) AS bin, f.lo + f.i * ((f.hi - f.lo) / {n}) AS bin_start,
  f.lo + f.i * ((f.hi - f.lo) / {n}) + (f.hi - f.lo) / {n} AS bin_end, coalesce(k.n, 0) AS count
 FROM {inner} f LEFT JOIN k ON k.variable = f.variable AND k.bin = f.i{match}"""


def grids(points: str, n: int, keep: str = "") -> str:
    """2-D bin counts of a (variable, x, y) table."""
    k = f"{keep}, " if keep else ""
    return f"""WITH l AS ({points}), r AS (SELECT variable, min(x) AS x0, max(x) AS x1, min(y) AS y0,
  max(y) AS y1 FROM l GROUP BY variable)
 SELECT l.variable, {k}{bins('x', 'x0', 'x1', n)} AS x_bin, {bins('y', 'y0', 'y1', n)} AS y_bin,
  count(*) AS count FROM l JOIN r ON l.variable = r.variable GROUP BY ALL"""


#: Squarings of the correlation matrix: its 2^13th power leaves one direction to rounding.
SQUARINGS = 13


def components(columns: Sequence[str], k: int = 2) -> list[str]:
    """Power iteration with deflation: ``pc(c, l)`` are eigenvalues, ``pv(c, i, v)`` unit vectors
    whose largest entry is positive, ``pz`` the standardised columns z1, z2, ..."""
    d = range(1, len(columns) + 1)
    stats = _join([f"avg(coalesce({c}, 0)) AS a{i}, stddev_pop(coalesce({c}, 0)) AS w{i}"
                   for i, c in zip(d, columns)])
    zs = _join([f"(coalesce({c}, 0) - a{i}) / CASE WHEN w{i} = 0 THEN 1 ELSE w{i} END AS z{i}"
                for i, c in zip(d, columns)])
    pairs = _join([f"avg(z{i} * z{j}) AS p{i}_{j}" for i in d for j in d if i <= j])
    cells = _join([f"({i}, {j}, p{min(i, j)}_{max(i, j)})" for i in d for j in d])
    ctes = [f"pz AS MATERIALIZED (SELECT s.*, {zs} FROM s, (SELECT {stats} FROM s))",
            f"pm AS MATERIALIZED (SELECT {pairs} FROM pz)",
            f"d1 AS MATERIALIZED (SELECT i, j, v FROM pm, LATERAL (VALUES {cells}) t(i, j, v))"]
    for c in range(1, k + 1):
        before = f"d{c}"
        for step in range(SQUARINGS):
            ctes.append(f"d{c}_{step} AS MATERIALIZED (SELECT i, j, v / sum(v) FILTER (WHERE i = j) "
                        f"OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {before} a "
                        f"JOIN {before} b ON a.j = b.i GROUP BY a.i, b.j))")
            before = f"d{c}_{step}"
        ctes += [f"v{c} AS MATERIALIZED (SELECT j AS i, v / sqrt(sum(v * v) OVER ()) AS v FROM {before} "
                 f"WHERE i = (SELECT i FROM {before} WHERE i = j ORDER BY v DESC, i LIMIT 1))",
                 f"l{c} AS MATERIALIZED (SELECT sum(a.v * m.v * b.v) AS l FROM d{c} m JOIN v{c} a "
                 f"ON a.i = m.i JOIN v{c} b ON b.i = m.j)",
                 f"d{c + 1} AS MATERIALIZED (SELECT m.i, m.j, m.v - l * a.v * b.v AS v FROM d{c} m "
                 f"JOIN v{c} a ON a.i = m.i JOIN v{c} b ON b.i = m.j, l{c})"]
    parts = range(1, k + 1)
    ctes += ["pc AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {c} AS c, l FROM l{c}" for c in parts) + ")",
             "pv AS MATERIALIZED (" + " UNION ALL ".join(
                 f"SELECT {c} AS c, i, v * (SELECT sign(v) FROM v{c} ORDER BY abs(v) DESC, i LIMIT 1) "
                 f"AS v FROM v{c}" for c in parts) + ")"]
    return ctes


_MEANT = [("bearer_id", "identifier", "identifier of the session"),
          ("user_id", "identifier", "identifier of the user"),
          ("imsi", "identifier", "identifier of the subscriber card"),
          ("imei", "identifier", "identifier of the device"),
          ("start_ts", "time", "start of the session"), ("end_ts", "time", "end of the session"),
          ("start_ms", "time", "start of the session, millisecond part"),
          ("end_ms", "time", "end of the session, millisecond part"),
          ("dur_ms", "measure", "duration of the session in milliseconds"),
          ("handset_manufacturer", "category", "maker of the handset"),
          ("handset_type", "category", "model of the handset"),
          ("rtt_dl_ms", "measure", "downlink round-trip time in milliseconds"),
          ("rtt_ul_ms", "measure", "uplink round-trip time in milliseconds"),
          ("tp_dl_kbps", "measure", "downlink throughput in kbit/s"),
          ("tp_ul_kbps", "measure", "uplink throughput in kbit/s"),
          ("tcp_dl_bytes", "measure", "downlink TCP retransmissions in bytes"),
          ("tcp_ul_bytes", "measure", "uplink TCP retransmissions in bytes"),
          *[(f"{a}_{w}", "measure", f"{t} {d} volume in bytes") for a, t in (
              ("social_media", "Social Media"), ("google", "Google"), ("email", "Email"),
              ("youtube", "YouTube"), ("netflix", "Netflix"), ("gaming", "Gaming"),
              ("other", "Other")) for w, d in (("dl", "downlink"), ("ul", "uplink"))],
          ("total_dl", "measure", "total downlink volume in bytes"),
          ("total_ul", "measure", "total uplink volume in bytes"),
          ("total_data", "measure", "total volume of both directions in bytes")]
_HELD = [("bearer_id", "bigint"), ("user_id", "bigint"), ("start_ts", "timestamp_ntz"),
         ("handset_manufacturer", "string"), ("handset_type", "string"),
         *[(c, "double") for c in MEASURES]]
FIELD_DICTIONARY = (
    "SELECT * FROM (VALUES " + _join([f"('{v}', '{k}', '{d}')" for v, k, d in _MEANT])
    + ") m(variable, kind, description) FULL JOIN (SELECT * FROM (VALUES "
    + _join([f"('{c}', '{t}')" for c, t in _HELD]) + ") t(variable, dtype) JOIN ("
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS filled FROM s" for c, _ in _HELD)
    + ") n USING (variable)) h USING (variable)")

INSIGHTS = """('Low Satisfaction Users', 'Low engagement AND poor network experience. Immediate intervention required: investigate coverage gaps, reduce TCP retransmission rates, and proactively reach out with service-improvement offers to prevent churn.'),
 ('High Satisfaction Users', 'High engagement AND superior network experience. These are VIP customers: high data consumers with low latency and minimal packet loss. Protect with loyalty programmes, early access to new services, and dedicated support channels.')"""
