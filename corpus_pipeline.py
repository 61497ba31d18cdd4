"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``, the last returns ids.  Null texts count as empty ones until the last stage
and stay null; null ids are kept.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.llm import bpe, decontaminate, pii, quality, simhash
from usagelens.llm.common import prepare, stored, table, whole_text

#: A trained classifier, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    prepare(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints linked at three bits or fewer the smallest id stays."""
    prepare(spark)
    return simhash.one_per_group(docs, simhash.WORDS, simhash.BITS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; ``n_chars`` follows the text."""
    prepare(spark)
    masked = docs.withColumn("text", pii.mask(F.col("text")))
    if "n_chars" not in docs.columns:
        return masked
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    prepare(spark)
    coded = docs.select("doc_id", whole_text().alias("text"), bpe.encode(whole_text()).alias("ids"))
    return coded.select(
        "doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        (bpe.decode(F.col("ids")) == F.encode("text", "UTF-8")).alias("round_trip"),
        bpe.ids_array(F.col("ids")).alias("ids"))


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies),
          ("benchmark", drop_benchmark), ("personal_data", mask_personal),
          ("tokens", to_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
