import numpy as np
from pyspark.sql import types as T

from usagelens.llm import neighbours

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("ids", T.StringType()), T.StructField("cell", T.StringType())])


def brute(vectors, query, k):
    ids = sorted(i for i in vectors if i != query)
    d = [float(np.sqrt(((np.array(vectors[i], "f8") - np.array(vectors[query], "f8")) ** 2).sum()))
         for i in ids]
    return sorted(zip(d, ids))[:k]


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in rows.collect()}
    found = neighbours.search(rows, every=20).collect()
    hits = total = 0
    for q in (i for i in vectors if i % 20 == 0):
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(np.isclose(s, brute({q: vectors[q], v: vectors[v]}, q, 1)[0][0], rtol=1e-14)
                   for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        best = {i for _, i in brute(vectors, q, 10)}
        hits, total = hits + len(best & {v for _, v, _ in own}), total + 10
    assert hits / total >= 0.95


def test_cells_blocks_and_query_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    monkeypatch.setattr(neighbours, "SAMPLE", 64)
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=6).astype("f4").tolist() for i in range(700)}
    rows = spark.createDataFrame([(i, v, "", "") for i, v in vectors.items()], SCHEMA)
    found = neighbours.search(rows, every=50, k=5).collect()
    hits = sum(r.vec_id in {i for _, i in brute(vectors, r.query_id, 5)} for r in found)
    assert len(found) == 14 * 5 and hits / len(found) > 0.9


def test_ties_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, "", "") for i in range(60)]
    rows += [(i, rng.normal(size=3).tolist(), "", "") for i in range(60, 99)]
    rows += [(0, same, "", ""), (7, same, "", ""), (None, same, "", ""), (100, None, "", ""),
             (200, [0.0, 0.0, 0.0], "", ""), (300, [1.0, None, 2.0], "", ""),
             (400, [1.0, float("nan"), 2.0], "", ""), (500, [1.0, float("inf"), 2.0], "", ""),
             (600, [1.0, 2.0], "", ""), (700, [], "", "")]
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.query_id for r in found} == {0}
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(i, i, 0.0) for i in range(1, 11)]


def test_every_vector_of_an_id_is_a_row(spark, monkeypatch):
    """Ids on several rows: each vector is a candidate, and a query if its id is asked for."""
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(5)
    vectors = [(i % 90, rng.normal(size=3).astype("f4").tolist()) for i in range(240)]
    vectors += vectors[:15]
    found = neighbours.search(spark.createDataFrame([(i, v, "", "") for i, v in vectors], SCHEMA),
                              every=30, k=6, confidence=0.999999).collect()
    rows = sorted({(i, tuple(v)) for i, v in vectors})
    expected = []
    for q, own in rows:
        if q % 30 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())), i)
                          for i, v in rows if (i, v) != (q, own))[:6]
            expected += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(expected)


def test_cells_are_copied_by_their_visits(spark):
    """The index moves as often as blocks of queries visit a cell, not once per block of all."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "", "") for i in range(500)], SCHEMA)
    plan = neighbours.search(rows, every=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "parts" in plan and "Cross" not in plan


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0], "", ""), (1, [0.0, 1.0], "", ""), (2, [1.0, 1.0], "", "")]
    found = neighbours.search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.rank, r.vec_id) for r in found) == [(1, 2), (2, 1)]
    assert neighbours.search(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert neighbours.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chi_square_quantiles():
    for p, m, x in ((0.95, 2, 5.991), (0.99, 8, 20.090), (0.5, 10, 9.342)):
        assert abs(neighbours.chi_square_quantile(p, m) - x) < 1e-3
