"""Documents with every awkward case, and columns whose names the operators use themselves."""

import random

import pytest
from pyspark.sql import types as T

CLASHES = ["fingerprint", "component_id", "row_number", "ids", "decoded", "numbers", "score", "label",
           "shard", "slot", "found", "spans", "held_out", "draws", "file_no", "toxic", "severity"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHES]])
WORDS = ["the", "river", "stone", "over", "under", "green", "house", "maße", "été", "niño", "tree,",
         "light.", "Dark", "seven", "of", "and"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing"]) for _ in range(n))


def rows_of_documents() -> list[tuple]:
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    texts = base + base[:6] + [t.replace("river", "lake", 1) for t in base[:10]]
    texts += [None, None, "", "", "one", "two words", " \t\n", "  spaced  out  \n\n text ",
              "漢字かな 🎉  x", "a" * 30_000, prose(rng, 20_000), "UPPER lower", "upper LOWER"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (None, "no id here"), (None, texts[4]), (None, None)]
    return [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in rows]


@pytest.fixture(scope="session")
def document_rows():
    return rows_of_documents()


@pytest.fixture(scope="session")
def documents(spark, document_rows):
    return spark.createDataFrame(document_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
