"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.llm import (bpe, centroids, chat, decontaminate, imatch, neighbours, pii, quality,
                            sharding, simhash, tokenfile, toxicity, whitening)
from usagelens.llm.common import table, unsigned_hex, whole_text


def op1_simhash(spark: SparkSession, directory: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, directory, "documents"))
    return found.select("doc_id", unsigned_hex(F.col("fingerprint")).alias("fingerprint"),
                        "component_id")


def op2_sharding(spark: SparkSession, directory: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, directory, "documents"),
                                      sharding.Tree.even(40), sharding.Tree.even(41))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3_chat(spark: SparkSession, directory: str) -> DataFrame:
    return chat.format_chats(table(spark, directory, "conversations"))


#: Conversations as lists of turns; a shorter list that is a beginning of a longer one goes.
CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role,
                  coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text)
             AS said FROM t GROUP BY conv_id),
u AS (SELECT said, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY said),
p AS (SELECT DISTINCT said[1:n] AS said FROM u, unnest(range(1, len(said))) r(n)
      WHERE said[n].turn < said[n + 1].turn),
k AS (SELECT u.* FROM u ANTI JOIN p ON u.said = p.said)
SELECT t.conv_id, CAST(floor(t.turn / 1024) AS BIGINT) AS segment,
       CAST(any_value(len(said)) AS BIGINT) AS n_turns, any_value(n_equal) AS n_equal,
       string_agg('<|im_start|>' || CASE role WHEN '' THEN 'unknown' ELSE role END || chr(10)
                  || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY t.conv_id, floor(t.turn / 1024)"""


def op4_bpe(spark: SparkSession, directory: str) -> DataFrame:
    ids = table(spark, directory, "documents").select(
        "doc_id", bpe.encode(whole_text()).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids")).alias("decoded"))
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.grade_documents(table(spark, directory, "documents"),
                                    table(spark, directory, "labels"))


def op6_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.classify(table(spark, directory, "documents"),
                            table(spark, directory, "labels"))


def op7_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.search(table(spark, directory, "embeddings"))


def op8_tokenfile(spark: SparkSession, directory: str) -> DataFrame:
    manifest = tokenfile.write(table(spark, directory, "documents"))
    return tokenfile.read(spark, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, directory, "documents"),
                                        table(spark, directory, "benchmark"))


def op10_pii(spark: SparkSession, directory: str) -> DataFrame:
    found = table(spark, directory, "documents").select(
        "doc_id", pii.find(whole_text()).alias("found"))
    spans = F.col("found")
    return found.select("doc_id", *[pii.count(spans, k).alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.listed(spans, pii.BASE), 256).alias("base_sha256"),
                        pii.listed(spans).alias("spans"))


def op11_whitening(spark: SparkSession, directory: str) -> DataFrame:
    return whitening.whiten(table(spark, directory, "embeddings"))


def op12_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return imatch.with_edits(table(spark, directory, "documents"))


#: Hexadecimal limits of the subsets' bytes; every term is in subset 0.
_LIMITS = [(0, "g")] + [(8 * g + i, limit) for g, limit in enumerate(("40", "10", "04", "01"))
                        for i in range(1, 9)]
_TERMS = ("list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'))")
FINGERPRINT_SQL = f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(doc_id) OVER w, min(doc_id) OVER ())
             AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after
      FROM o WINDOW w AS (ORDER BY doc_id)),
x AS (SELECT doc_id, 0 AS side, text FROM d UNION ALL
      SELECT doc_id, 1, left(text, n - n // 2) || left(after, n // 2) FROM d),
t AS (SELECT doc_id, side, unnest({_TERMS}) AS term FROM x),
l AS (SELECT term, true AS inside FROM t WHERE side = 0 GROUP BY term
      HAVING count(*) BETWEEN (SELECT count(*) FROM o) * CAST(0.001 AS DOUBLE)
                      AND (SELECT count(*) FROM o) * CAST(0.3 AS DOUBLE)),
k AS (SELECT doc_id, side, term, inside, bool_or(inside) OVER (PARTITION BY doc_id, side) AS hit
      FROM t LEFT JOIN l USING (term)),
p AS (SELECT doc_id, side, term, sha256(term) AS s FROM k WHERE inside OR hit IS NULL UNION ALL
      SELECT doc_id, side, text, sha256(text) FROM x WHERE len({_TERMS}) = 0),
s(i, hi) AS (VALUES {", ".join(f"({i}, '{hi}')" for i, hi in _LIMITS)}),
h AS (SELECT doc_id, side, i, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS piece
      FROM p JOIN s ON i = 0 OR substr(p.s, 2 * i - 1, 2) < hi GROUP BY doc_id, side, i),
f AS (SELECT doc_id, side, list(coalesce(piece, '--------') ORDER BY i) AS pieces
      FROM x CROSS JOIN s LEFT JOIN h USING (doc_id, side, i) GROUP BY doc_id, side)
SELECT d.doc_id, n AS n_chars, sha256(e.text) AS edited_sha256,
       array_to_string(a.pieces, '') AS fingerprint, array_to_string(b.pieces, '') AS edited_fingerprint,
       len([1 for z in list_zip(a.pieces, b.pieces) if z[1] = z[2] AND z[1] <> '--------']) /
       len([1 for z in list_zip(a.pieces, b.pieces) if z[1] <> '--------' OR z[2] <> '--------'])
       AS near_edited,
       len([1 for z in list_zip(a.pieces, c.pieces) if z[1] = z[2] AND z[1] <> '--------']) /
       len([1 for z in list_zip(a.pieces, c.pieces) if z[1] <> '--------' OR z[2] <> '--------'])
       AS near_next
FROM d JOIN x e ON e.doc_id = d.doc_id AND e.side = 1
JOIN f a ON a.doc_id = d.doc_id AND a.side = 0 JOIN f b ON b.doc_id = d.doc_id AND b.side = 1
JOIN f c ON c.doc_id = d.next_id AND c.side = 0"""


def op13_centroids(spark: SparkSession, directory: str) -> DataFrame:
    return centroids.cluster(table(spark, directory, "embeddings")).described()


def _lloyd_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    far = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.x, c.x)])"

    def nearest(r: int) -> str:
        return (f"a{r} AS MATERIALIZED (SELECT * FROM (SELECT v.row, v.vec_id, v.x, c.cl, "
                f"CAST({far} AS BIGINT) AS d, row_number() OVER (PARTITION BY v.row ORDER BY {far}, "
                f"c.cl) AS pick FROM v, c{r} c) WHERE pick = 1)")

    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, 
 [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS x FROM embeddings
 WHERE len(embedding) = {size} AND len([1 for e in embedding if isfinite(e)]) = {size})""",
            "c0 AS MATERIALIZED (SELECT cl - 1 AS cl, x FROM (SELECT x, row_number() OVER "
            f"(ORDER BY sha256('1:' || vec_id), x) AS cl FROM v) WHERE cl <= {k})"]
    for r in range(rounds):
        ctes += [nearest(r), f"""c{r + 1} AS MATERIALIZED (SELECT c.cl, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
 (SELECT cl, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (SELECT cl, i, count(*) AS n,
  CAST(sum(x[i]) AS BIGINT) AS s FROM a{r}, range(1, {size + 1}) t(i) GROUP BY cl, i) GROUP BY cl) m
 USING (cl))"""]
    return "WITH " + ",\n".join([*ctes, nearest(rounds)]) + f"""
SELECT vec_id, CAST(a.cl AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a.cl) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cl = c.cl"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_sharding, op3_chat, op4_bpe, op5_toxicity, op6_quality, op7_neighbours,
                            op8_tokenfile, op9_decontamination, op10_pii, op11_whitening,
                            op12_fingerprints, op13_centroids)}
ORACLES: dict[str, str] = {"op3_chat": CHAT_SQL, "op12_fingerprints": FINGERPRINT_SQL,
                           "op13_centroids": _lloyd_sql()}
