"""Run registered queries in Spark and DuckDB and compare the results.

    python -m checks.compare [data folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections.abc import Iterable
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.queries import REGISTRY


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _normal(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(columns: list[str], rows: Iterable) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_normal(r[i]) for i in order)) for r in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str,
            directory: str) -> str | None:
    """None if both sides agree, else a description of the difference."""
    df = REGISTRY[name].frame(spark, directory)
    ours = rows_of(df.columns, df.collect())
    sql = REGISTRY[name].sql()
    if sql is None:
        return None if ours else "no rows"
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if ours != theirs:
        mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
        return (f"{len(ours)} vs {len(theirs)} rows, {len(mine)} differ\n"
                f"   spark {sorted(mine)[:2]}\n   sql   {sorted(other)[:2]}")
    return None


def main() -> int:
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(directory), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, directory)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        kind = "sql" if REGISTRY[name].final else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {name} {time.time() - start:.1f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
