"""Where intermediate tables live.

Iterative operators (k-means, elbow, cross validation) read one small-ish user
table many times.  It is written once as Parquet below the cluster's shared
checkpoint folder and read back: that cuts the lineage, survives the loss of
executors, and keeps column pruning and size statistics for the re-reads.

The folder is always named by the session.  All of one application lies in one
folder of its own, which :func:`drop_scratch` deletes when the work is done.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Wide tables of doubles take a quarter less room than with the writer's default, in the same time.
COMPRESSION = "zstd"
#: Whether an action's shuffle files go when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """This application's folder below the shared one that the session names."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return f"{named.rstrip('/')}/usagelens-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of an action when it ends: for tables that are written to be read
    back, whose shuffles nobody reads again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with passing_shuffles(spark):
        df.write.parquet(path, compression=COMPRESSION)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application has materialised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def allow_rdd_checkpoints(spark: SparkSession) -> None:
    """Let ``pyspark.ml`` cut the lineage of boosting rounds; keeps a folder already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    workers, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = workers.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
