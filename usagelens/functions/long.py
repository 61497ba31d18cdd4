"""Long form: one ``(variable, value)`` row per numeric cell.

Statistics over many columns are computed on the long form.  One set of
aggregates grouped by ``variable`` stays inside compiled code however wide the
table is, while the same aggregates spelled out per column grow past the size
the JVM compiles.  Partial aggregation leaves one row per variable and task, so
the shuffle is tiny.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def to_long(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
            keep: Sequence[str] = (), variable: str = "variable",
            value: str = "value", drop_null: bool = True) -> DataFrame:
    """Unpivot ``columns`` (names, or a mapping name -> expression) to doubles."""
    exprs = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    shaped = df.select(*keep, *[e.cast("double").alias(name) for name, e in exprs.items()])
    long = shaped.unpivot(list(keep), list(exprs), variable, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long
