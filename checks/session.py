"""What the registered queries share: a scratch folder, the stored joined rows of the session view
and the cleaned sessions."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

from usagelens.sources.files import StoredTable, input_fingerprint, load_or_create_cleaned
from usagelens.sources.warehouse import VIEW_TABLES, joined_rows, session_view, table_path
from usagelens.workspace import CHECKPOINT_DIR, shared_root

SCAN_BYTES, DEFAULT_SCAN_BYTES = "spark.sql.files.maxPartitionBytes", "134217728b"


def ensure_scratch(spark: SparkSession) -> None:
    """Name a folder of our own where a local session names none."""
    if spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir():
        return
    master = spark.sparkContext.master
    if not master.startswith("local") or "cluster" in master:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    own = tempfile.mkdtemp(prefix="usagelens-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")


def small_scans(spark: SparkSession) -> None:
    """Bound the rows of a task that reads joined rows, unless the session bounds its scans itself.

    A joined row takes 15 bytes stored; a task of the default 128 MB would group eight million of them.
    """
    if spark.conf.get(SCAN_BYTES) == DEFAULT_SCAN_BYTES:
        spark.conf.set(SCAN_BYTES, "32m")


def _inputs(directory: str) -> list[str]:
    return [table_path(directory, t) for t in VIEW_TABLES]


def stored_rows(spark: SparkSession, directory: str) -> DataFrame:
    """The joined rows of the session view, stored once per application and data folder."""
    ensure_scratch(spark)
    name, inputs = hashlib.md5(directory.encode()).hexdigest(), _inputs(directory)
    return StoredTable(spark, f"{shared_root(spark)}/joined-{name}").load_or_create(
        input_fingerprint(spark, inputs), lambda: joined_rows(spark, directory))


def joined_once(spark: SparkSession, directory: str) -> DataFrame:
    """The session view over its stored joined rows, for whoever reads the view several times."""
    return session_view(spark, directory, stored_rows(spark, directory))


def cleaned_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """The session view cleaned: fitted once per application and data folder, a projection of the
    stored joined rows."""
    ensure_scratch(spark)
    small_scans(spark)
    name = hashlib.md5(directory.encode()).hexdigest()
    return load_or_create_cleaned(spark, f"{shared_root(spark)}/cleaned-{name}",
                                  lambda: joined_once(spark, directory),
                                  inputs=_inputs(directory), keep="model")
