"""Splitting a table by global rank without ranking it.

To put rows into deciles or contiguous folds only the few rows at the borders matter.  The
(value, tie key) pairs are dealt over range partitions, the partitions are counted, and the
border rows are read off by their place within one partition.  Membership is then a
comparison with literals, a projection without any shuffle.  Both columns may have any
orderable type, and the way is the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.workspace import materialise


@dataclass(frozen=True)
class Border:
    """Last row of a segment."""

    value: Any
    tie: Any


def border_rows(df: DataFrame, value: Column, tie: Column,
                ranks: Callable[[int], Sequence[int]]) -> list[Border]:
    """Borders at the 1-based ranks ``ranks(n)`` in (value, tie) order; null values have none."""
    order = ["value", "tie"]
    rows = df.select(value.alias("value"), tie.alias("tie")).where(F.col("value").isNotNull())
    dealt = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()),
                        "ranked")
    sizes = dealt.groupBy("part").count().orderBy("part").collect()  # one row per partition
    if not sizes:
        return []
    spots = []
    for rank in ranks(sum(s["count"] for s in sizes)):
        before = 0
        for s in sizes:
            if rank <= before + s["count"]:
                break
            before += s["count"]
        spots.append((s.part, rank - before))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    wanted = reduce(Column.__or__, [(F.col("part") == p) & (F.col("place") == i)
                                    for p, i in set(spots)])
    found = {(r.part, r.place): Border(r.value, r.tie) for r in
             dealt.where(F.col("part").isin(*{p for p, _ in spots}))
             .withColumn("place", place).where(wanted).collect()}
    return [found[s] for s in spots]


def bucket(value: Column, tie: Column, borders: Sequence[Border], first: int = 1) -> Column:
    """``first`` plus the number of borders a row lies strictly behind."""
    number = F.lit(first)
    for b in borders:
        behind = (value > F.lit(b.value)) | ((value == F.lit(b.value)) & (tie > F.lit(b.tie)))
        number = number + behind.cast("int")
    return number
