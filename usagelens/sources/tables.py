"""Relational sinks and sources: catalog tables, or JDBC if options are given.

Credentials come from the caller's options and are never kept here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# pandas-style wording -> Spark save mode
_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def export_table(df: DataFrame, name: str, if_exists: str = "replace",
                 jdbc: Mapping[str, str] | None = None, path: str | None = None) -> bool:
    """Write a table; True once written, any failure raises.

    ``path`` places a catalog table outside the warehouse folder.
    """
    if if_exists not in _MODES:
        raise ValueError(f"if_exists must be one of {', '.join(_MODES)}")
    writer = df.write.mode(_MODES[if_exists])
    if jdbc is None:
        (writer.option("path", path) if path else writer).saveAsTable(name)
    else:
        # batched inserts from every partition; numPartitions caps the connections
        writer.format("jdbc").options(**{"batchsize": "10000", **jdbc, "dbtable": name}).save()
    return True


def read_table(spark: SparkSession, name: str,
               jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """Read a whole table.

    For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``, otherwise a single task reads the table.
    """
    if jdbc is None:
        return spark.table(name)
    return spark.read.format("jdbc").options(**{**jdbc, "dbtable": name}).load()


def run_query(spark: SparkSession, sql: str, jdbc: Mapping[str, str] | None = None,
              **tables: DataFrame) -> DataFrame:
    """Run SQL over catalog tables and the given frames, or in the JDBC database."""
    if jdbc is None:
        return spark.sql(sql, **tables)
    return spark.read.format("jdbc").options(**{**jdbc, "query": sql}).load()
