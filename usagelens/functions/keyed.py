"""Exact quantiles of many keys, however many, with nothing per key on the driver.

Equal values of a key are counted first, so a value that a third of the rows share is one row.
Values fall into places that grow with them (steps of a 64th of an octave); the counts per
(key, place) tell in which place a wanted rank lies.  That place is cut into equal parts and its
rows are counted again, until the part that holds the rank has a single value.  Every round
divides the width by ``PARTS``, so a handful settles any doubles.  A window sees the places or
parts of one key, never its rows; rounds only look at rows of places that are still open, which are
joined by key and place, so a key with most rows is spread over its places.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.workspace import materialise

#: Places per octave, parts per round, rounds: 4096 ** 7 is beyond the doubles of a place.
STEPS, PARTS, ROUNDS = 64, 4096, 7
#: More than the places between one and the largest or smallest double.
BEYOND = STEPS * 1100


def _place(value: Column) -> Column:
    """A number that never falls as the value grows; values of one place differ by about a per cent."""
    octaves = F.least(F.log2(F.abs(value)) * STEPS, F.lit(float(BEYOND)))
    return F.when(value == 0, F.lit(0)).otherwise(
        F.signum(value) * (F.floor(octaves) + BEYOND)).cast("long")


def _located(parts: DataFrame, asked: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Which of the parts (in ``order``) holds each asked rank, and the rank within it."""
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    through = parts.withColumn("through", F.sum("n").over(running))
    before = F.col("through") - F.col("n")
    return through.join(asked.select(*{*by, "key", "request", "rank"}), list(by)).where(
        (F.col("rank") > before) & (F.col("rank") <= F.col("through"))).select(
        "key", "request", (F.col("rank") - before).alias("rank"), "place", "lo", "hi")


def keyed_quantiles(long: DataFrame, fractions: Sequence[float], key: str = "variable",
                    value: str = "value") -> DataFrame:
    """``key, n, low, high, q0, q1, ...``: linearly interpolated quantiles, one row per key.

    Rows without a key or a value are left out.
    """
    known = long.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).where(
        F.col("key").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    counted = materialise(known.groupBy("key", "value").agg(F.count("*").alias("n"))
                          .withColumn("place", _place(F.col("value"))), "counted")
    ends = [F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    places = materialise(counted.groupBy("key", "place").agg(*ends), "places")
    sizes = places.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("low"),
                                      F.max("hi").alias("high"))
    spots = [F.lit(float(p)) * (F.col("n") - 1) for p in fractions]
    ranks = F.array(*[r.cast("long") + 1 for s in spots for r in (F.floor(s), F.ceil(s))])
    asked = sizes.select("key", F.posexplode(ranks).alias("request", "rank"))
    state, settled = materialise(_located(places, asked, ["key"], "place"), "ranks"), []
    for _ in range(ROUNDS):
        settled.append(state.where("lo = hi").select("key", "request", F.col("lo").alias("value")))
        left = state.where("lo < hi")
        if left.isEmpty():
            break
        width = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        rows = counted.join(left.drop("rank"), ["key", "place"]).where("value BETWEEN lo AND hi")
        parts = rows.groupBy("key", "request", "place", F.least(
            F.floor(width * PARTS), F.lit(PARTS - 1)).alias("part")).agg(*ends)
        state = materialise(_located(parts, left, ["key", "request"], "part"), "ranks")
    else:
        raise RuntimeError(f"ranks are still open after {ROUNDS} rounds")
    found = reduce(DataFrame.unionByName, settled).groupBy("key").agg(*[
        F.max(F.when(F.col("request") == i, F.col("value"))).alias(f"v{i}")
        for i in range(2 * len(fractions))])
    between = [(F.col(f"v{2 * j}") + (F.col(f"v{2 * j + 1}") - F.col(f"v{2 * j}"))
                * (s - F.floor(s))).alias(f"q{j}") for j, s in enumerate(spots)]
    return sizes.join(found, "key").select(F.col("key").alias(key), "n", "low", "high", *between)
