"""What every operator here needs: shared scratch, worker settings, names without clashes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one Arrow batch: a thousand texts of 100 KB are still a bounded piece of memory.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()


def prepare(spark: SparkSession) -> None:
    """Settings an operator relies on; what the session already names is kept.

    A scratch folder of our own is made only where none is named and the driver and the
    executors are one process, as in tests.
    """
    if not shared_folder(spark):
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        own = tempfile.mkdtemp(prefix="usagelens-llm-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    workers, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = workers.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder of the session."""
    prepare(spark)
    folder = shared_folder(spark).rstrip("/")
    return f"{folder}/llm-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and return a scan of it.

    Cuts the lineage, survives lost executors and keeps column pruning for later reads.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: Sequence[str], wish: str) -> str:
    """``wish``, or the first of ``wish_1``, ``wish_2``, ... that no column has."""
    low = {c.lower() for c in taken}
    return next(n for n in (wish, *(f"{wish}_{i}" for i in range(1, len(low) + 2)))
                if n.lower() not in low)


def whole_text(column: str = "text") -> Column:
    """The text; a null text is an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def unsigned_hex(column: Column) -> Column:
    """A 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
