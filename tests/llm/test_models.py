import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from usagelens.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return (spark.read.parquet(f"{SF}/documents.parquet").repartition(4).cache(),
            spark.read.parquet(f"{SF}/labels.parquet").cache())


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    ones = np.array(labels) == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


def test_quality_on_held_out_rows(spark, corpus):
    documents, labels = corpus
    scored = quality.classify(documents, labels)
    assert scored.count() == documents.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert area([r.score for r in rows], [r.quality for r in rows]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    some = scored.limit(200).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in some)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in some)


def test_held_out_labels_are_not_read(spark, corpus):
    documents, labels = corpus
    numbers = documents.select("doc_id", quality.statistics(F.col("text")).alias("numbers")).cache()
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    one, two = quality.fit(numbers, labels), quality.fit(numbers, turned)
    assert np.allclose(one.weights, two.weights)


def test_normal_equations_equal_one_pass(spark, corpus):
    documents, labels = corpus
    numbers = documents.select("doc_id", quality.statistics(F.col("text")).alias("numbers"))
    model = quality.fit(numbers, labels)
    rows = quality.labelled(numbers, labels).collect()
    x = model.features(np.array([r.numbers for r in rows]))
    y = np.array([r.label for r in rows])
    penalty = quality.RIDGE * len(y) * np.eye(x.shape[1]) / x.shape[1]
    penalty[-1, -1] = 0
    assert np.allclose(x @ model.weights, x @ np.linalg.solve(x.T @ x + penalty, x.T @ y), atol=1e-6)


@given(st.lists(st.tuples(st.integers(1, 5), st.floats(0, 1)), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_isotonic_is_monotone_and_keeps_the_mean(pairs):
    w, v = np.array(pairs).T
    fit = quality.isotonic(w, v)
    assert (np.diff(fit) >= -1e-12).all() and np.isclose((w * fit).sum(), (w * v).sum())


def test_awkward_documents_are_scored(spark, documents, document_rows):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(2, None, None), (5, 1, 1),
                                   (None, 1, 1), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(documents, labels).collect()
    assert len(rows) == len(document_rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality.accepted(documents, labels).columns == documents.columns
    graded = toxicity.grade_documents(documents, labels).collect()
    assert len(graded) == len(document_rows)
    assert all(r.severity >= 0 and 0 <= r.probability <= 1 for r in graded)


def test_without_labels_or_documents(spark, documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(documents, none).collect()} == {0.5}
    assert {r.toxic for r in toxicity.grade_documents(documents, none).collect()} == {0}
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(no_documents, some).count() == 0
    assert toxicity.grade_documents(no_documents, some).count() == 0


def test_toxicity_of_rows_it_did_not_learn_from(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    rows = (toxicity.grade_documents(documents, seen).join(
        labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").collect())
    truth = np.array([r.truth for r in rows])
    flagged = np.array([r.toxic for r in rows])
    assert area([r.severity for r in rows], truth) > 0.93
    assert flagged[truth == 1].mean() > 0.8 and flagged[truth == 0].mean() < 0.01


def test_grades_share_weights_over_ordered_thresholds():
    rng = np.random.default_rng(1)
    n = 4000
    row, column = np.arange(n).repeat(2), rng.integers(0, 6, 2 * n)
    w = np.array([2.0, -1.0, 0.0, 1.0, -2.0, 0.5])
    z = np.bincount(row, w[column], n)
    latent = z + rng.logistic(size=n)
    grade = np.searchsorted([0.0, 1.5, 3.0], latent)
    weights, thresholds = toxicity.ordinal((row, column, np.ones(2 * n)), grade, 6, 3)
    assert np.corrcoef(weights, w)[0, 1] > 0.98
    assert (np.diff(thresholds) > 0).all() and np.allclose(np.diff(thresholds), 1.5, atol=0.4)


def test_given_grades_are_used(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        g = i % 3
        rows.append((i, " ".join(rng.choice(["plain", "words", "here"]) for _ in range(20))
                     + [" ", " awful", " horrid horrid"][g], g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {r.doc_id: r.severity for r in toxicity.grade_documents(
        docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()}
    mean = [np.mean([found[i] for i, _, g in rows if g == k]) for k in range(3)]
    assert mean[0] < 0.5 < mean[1] < mean[2]
