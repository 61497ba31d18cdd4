"""Whitening and centroid clustering against plain Python and numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from usagelens.llm import centroids, feast, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType())),
                       *[T.StructField(c, T.StringType()) for c in
                         ("x", "n", "chunk", "block", "cluster", "distance", "component", "labels")]])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, *["x"] * 8) for i, v in rows], SCHEMA).repartition(parts)


def awkward(d=64, n=300, seed=3):
    """Repeated rows and ids, a vector that a third of the rows share, all kinds of bad vectors."""
    rng = np.random.default_rng(seed)
    good = rng.normal(0, 0.2, (n, d)) * rng.exponential(1, d)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(good)]
    rows += [(1000 + i, rows[5][1]) for i in range(n // 2)]
    rows += [rows[7], rows[7], (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    bad = list(rows[3][1])
    rows += [(2000, None), (2001, []), (2002, bad[:-1]), (2003, [*bad, 1.0]),
             (2004, [None, *bad[1:]]), (2005, [math.nan, *bad[1:]]), (2006, [*bad[1:], math.inf]),
             (2007, [*bad[1:], -math.inf]), (2008, [3e38, *bad[1:]])]
    return rows


def units(rows, d, shift=0):
    out = []
    for i, v in rows:
        if v is not None and len(v) == d and all(c is not None and abs(c) < 1e6 for c in v):
            out.append((i, tuple(math.floor(64 * c) + shift for c in v)))
    return out


def brute_lloyd(rows, k, rounds):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode())
                                        .hexdigest() if r[0] is not None else "", r[1]))
    centre = [list(x) for _, x in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centre))
                for _, x in rows]
    for _ in range(rounds):
        own = assigned()
        for j in range(len(centre)):
            members = [x for (_, x), (_, c) in zip(rows, own) if c == j]
            if members:
                centre[j] = [sum(column) // len(members) for column in zip(*members)]
    return [(i, j, d) for (i, _), (d, j) in zip(rows, assigned())], centre


@pytest.mark.parametrize("k,width", [(16, 16), (5, 64), (3, 7)])
def test_lloyd_equals_plain_python(spark, k, width):
    rows = awkward()
    found = centroids.cluster(frame(spark, rows), k=k, width=width)
    expected, centre = brute_lloyd(units(rows, 64), k, 3)
    assert found.centroids.tolist() == centre
    key = str
    assert sorted(map(tuple, found.rows.collect()), key=key) == sorted(expected, key=key)
    texts = [",".join(map(str, c)) for c in centre]
    sums = {j: sum(d for _, c, d in expected if c == j) for j in range(k)}
    for r in found.described().collect():
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values())
        assert r.centroid_sha256 == hashlib.sha256(texts[r.cluster].encode()).hexdigest()


def test_lloyd_with_few_far_and_no_vectors(spark):
    rows = [(1, [2e6] + [0.0] * 63), (2, [-2e6] + [0.5] * 63), (3, [2e6] + [0.0] * 63)]
    expected, centre = brute_lloyd([(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows], 16, 3)
    found = centroids.cluster(frame(spark, rows))
    assert found.centroids.tolist() == centre
    assert sorted(map(tuple, found.rows.collect())) == sorted(expected)
    none = centroids.cluster(frame(spark, [(1, None)])).described()
    assert none.collect() == [] and "centroid_sha256" in none.columns


def test_vectors_stay_put_between_rounds(spark):
    """Only partial distances, labels and sums move: the blocks are dealt once."""
    blocks = centroids.blocks_of(centroids.quantised(frame(spark, awkward()), 64, centroids.LIMIT))
    held = blocks.drop("ids").repartition(5, "chunk", "block").persist()
    held.count()
    start = np.zeros((2, 64), "i8")
    labels = centroids.nearest(held, start)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = centroids.labelled(held, labels, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        held.unpersist()
    assert "Exchange" not in text[:text.index("InMemoryTableScan")]


def brute_whitening(rows, d, k):
    kept = units(rows, d, 1_000_000)
    x = np.array(sorted({v for _, v in kept}), dtype=object)
    n, total = len(x), x.sum(axis=0)
    off = np.array([[float(v) for v in row] for row in n * x - total]) / n
    v = off.T @ off / n
    values, vectors = np.linalg.eigh(v)
    keep = [j for j in np.argsort(-values)[:k] if values[j] > 1e-12 * np.trace(v)]
    whole = {i: (sum((n * a - s) ** 2 for a, s in zip(y, total)),
                 np.array([float(n * a - s) for a, s in zip(y, total)]) / n
                 @ vectors[:, keep] / np.sqrt(values[keep])) for i, y in kept if i not in (7, None)}
    return n, kept, whole, values[keep] / np.trace(v)


@pytest.mark.parametrize("d", [64, 3])
def test_whitening_equals_dense_eigenvectors(spark, d):
    rows = awkward(d)
    found = whitening.whiten(frame(spark, rows)).collect()
    n, kept, whole, shares = brute_whitening(rows, d, 16)
    k = len(shares)
    assert len(found) == len(kept) * k and {r.n for r in found} == {n}
    assert {r.component for r in found} == set(range(1, k + 1))
    signs = {}
    for r in found:
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        if r.vec_id in whole:
            deviation, expected = whole[r.vec_id]
            sign = signs.setdefault(r.component, np.sign(r.whitened * expected[r.component - 1]))
            assert r.deviation == deviation
            assert abs(sign * r.whitened - expected[r.component - 1]) < 1e-7


def test_whitening_of_flat_and_empty_tables(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []
    line = whitening.whiten(frame(spark, [(i, [i / 4, 1.0, -i / 4]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    assert max(r.identity_error for r in line) < 1e-12


def test_whitening_far_from_zero(spark):
    """A large common offset takes no digits from the covariance."""
    rng = np.random.default_rng(1)
    near = [(i, [float(c) for c in np.float32(rng.normal(0, 1, 8))]) for i in range(200)]
    far = [(i, [c + 2.0 ** 18 for c in v]) for i, v in near]
    # the offset leaves a float 5 binary digits, so compare with what it stores
    found = whitening.whiten(frame(spark, far)).collect()
    n, kept, whole, shares = brute_whitening(
        [(i, [float(np.float32(c)) for c in v]) for i, v in far], 8, 16)
    assert max(r.identity_error for r in found) < 1e-9 and len(found) == 8 * 200 and n <= 200
    assert all(abs(r.explained / shares[r.component - 1] - 1) < 1e-9 for r in found)


@pytest.mark.parametrize("values", [
    np.geomspace(1, 1e-6, 40), np.ones(40), np.repeat([9.0, 5, 5, 2], 10),
    1 + np.arange(40) * 1e-9, np.array([3.0, 2, 1] + [0] * 37), np.array([1.0]), np.zeros(4)])
def test_feast_finds_every_pair(values):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    found, vectors = feast.leading((a + a.T) / 2, 16)
    expected = np.sort(values)[::-1][:16]
    expected = expected[expected > 1e-12 * values.sum()]
    assert np.allclose(found, expected, rtol=0, atol=1e-14 * max(1, values.sum()))
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max(initial=0) < 1e-9


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    form = feast.tridiagonal(a)
    for shift in np.linspace(-20, 20, 41):
        assert feast.count_above(form, shift) == (np.linalg.eigvalsh(a) > shift).sum()
