"""Exact order statistics without a global sort.

A global sort or an exact ``percentile`` funnels every distinct value into one
task.  Here a bounded sketch proposes a narrow bracket around each wanted rank,
one counting pass returns the distinct values inside the brackets together with
the number of rows below them, and the running count picks the exact value.  If
a bracket is still too full it is narrowed again; if a sketch was off, the count
shows it and the bracket is widened.  The result never depends on the sketch.

Only ``keys x ranks`` numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F, types as T

# (key, rows) -> (hint, first rank, last rank) per request
Ranks = Callable[[Any, int], Sequence[tuple[int, int, int]]]


@dataclass(frozen=True)
class RankPolicy:
    """``accuracy``: sketch size.  ``max_candidates``: rows one bracket may hold."""

    accuracy: int = 10_000
    max_candidates: int = 1_000_000
    grid: int = 256


@dataclass(frozen=True)
class Cut:
    """The value at one rank; ``below`` rows are smaller, ``ties`` rows equal it."""

    rank: int
    value: Any
    below: int
    ties: int


@dataclass(frozen=True)
class Profile:
    """Row count, extremes and the requested cuts of one key."""

    n: int
    low: Any
    high: Any
    cuts: tuple[tuple[Cut, Cut], ...]


@dataclass(frozen=True)
class _Request:
    key: Any
    first: int
    last: int
    lo: Any
    hi: Any
    floor: Any
    ceiling: Any


def order_statistics(long: DataFrame, hints: Sequence[float], ranks: Ranks,
                     key: str = "variable", value: str = "value",
                     policy: RankPolicy = RankPolicy()) -> dict[Any, Profile]:
    """Values at exact ranks per key.

    ``ranks(key, n)`` lists what is wanted of a key with ``n`` rows: intervals of
    one or two adjacent 1-based ranks, each with the index of the hint (an
    approximate relative rank) that steers its first bracket.  Rows without a key or a
    value are left out.  Keys must be few (columns, clusters, categories).
    """
    known = long.select(F.col(key).alias("key"), F.col(value).alias("value")) \
                .where(F.col("key").isNotNull() & F.col("value").isNotNull())
    margin = 2.0 / policy.accuracy
    probes = [min(1.0, max(0.0, p + d)) for p in hints for d in (-margin, margin)]
    profiles = known.groupBy("key").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("value", probes, policy.accuracy).alias("probes")).collect()

    requests: list[_Request] = []
    owned: dict[Any, list[int]] = {p.key: [] for p in profiles}
    for p in profiles:
        for hint, first, last in ranks(p.key, p.n):
            owned[p.key].append(len(requests))
            requests.append(_Request(p.key, first, last, p.probes[2 * hint],
                                     p.probes[2 * hint + 1], p.low, p.high))
    crowded = any(4 * margin * p.n > policy.max_candidates for p in profiles)

    found: dict[int, tuple[Cut, Cut]] = {}
    open_ids = list(range(len(requests)))
    while open_ids:
        if crowded:
            requests = _narrow(known, requests, open_ids, policy)
        found |= _select(known, requests, open_ids)
        open_ids = [i for i in open_ids if i not in found]
        for i in open_ids:  # a sketch missed: start over from the certain range
            if (requests[i].lo, requests[i].hi) == (requests[i].floor, requests[i].ceiling):
                raise RuntimeError(f"no value at rank {requests[i].first} of {requests[i].key!r}")
            requests[i] = replace(requests[i], lo=requests[i].floor, hi=requests[i].ceiling)
        crowded = True

    return {p.key: Profile(p.n, p.low, p.high, tuple(found[i] for i in owned[p.key]))
            for p in profiles}


def _bracket_table(known: DataFrame, requests: list[_Request], ids: list[int]) -> DataFrame:
    types = known.schema
    schema = T.StructType([
        T.StructField("key", types["key"].dataType),
        T.StructField("request", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("lo", types["value"].dataType),
        T.StructField("hi", types["value"].dataType)])
    rows = [(requests[i].key, i, requests[i].first, requests[i].last,
             requests[i].lo, requests[i].hi) for i in ids]
    # keys x fractions rows, built on the driver: always broadcastable
    return F.broadcast(known.sparkSession.createDataFrame(rows, schema))


def _select(known: DataFrame, requests: list[_Request],
            ids: list[int]) -> dict[int, tuple[Cut, Cut]]:
    """Count inside the brackets and read the wanted ranks off the running count."""
    brackets = _bracket_table(known, requests, ids)
    counted = (known.join(brackets.select("key", "request", "lo", "hi"), "key")
               .where(F.col("value") <= F.col("hi"))
               .groupBy("request", F.when(F.col("value") >= F.col("lo"), F.col("value"))
                                    .alias("value"))
               .agg(F.count("*").alias("ties")))
    running = Window.partitionBy("request").orderBy(F.col("value").asc_nulls_first()) \
                    .rowsBetween(Window.unboundedPreceding, 0)
    hits = (counted.withColumn("through", F.sum("ties").over(running))
            .join(brackets.select("request", "first", "last"), "request")
            .where((F.col("through") >= F.col("first"))
                   & (F.col("through") - F.col("ties") < F.col("last")))
            .select("request", "value", "ties", "through").collect())

    by_request: dict[int, list] = {}
    for h in hits:
        by_request.setdefault(h.request, []).append(h)
    found = {}
    for i, rows in by_request.items():
        def at(rank: int) -> Cut | None:
            for h in rows:
                if h.value is not None and h.through - h.ties < rank <= h.through:
                    return Cut(rank, h.value, h.through - h.ties, h.ties)
            return None
        pair = (at(requests[i].first), at(requests[i].last))
        if None not in pair:
            found[i] = pair
    return found


def _narrow(known: DataFrame, requests: list[_Request], ids: list[int],
            policy: RankPolicy) -> list[_Request]:
    """Shrink brackets until each is verified and holds few enough rows."""
    requests = list(requests)
    todo = list(ids)
    grid = [i / policy.grid for i in range(policy.grid + 1)]
    while todo:
        inside = F.col("value") >= F.col("lo")
        counts = {r.request: r for r in (
            known.join(_bracket_table(known, requests, todo), "key")
            .where(F.col("value") <= F.col("hi"))
            .groupBy("request")
            .agg(F.count(F.when(~inside, 1)).alias("below"),
                 F.count(F.when(inside, 1)).alias("inside"),
                 F.percentile_approx(F.when(inside, F.col("value")), grid, policy.accuracy)
                  .alias("probes"))
            .collect())}
        again = []
        for i in todo:
            q, c = requests[i], counts.get(i)
            below, count = (c.below, c.inside) if c else (0, 0)
            low_ok, high_ok = q.first > below, q.last <= below + count
            if not (low_ok and high_ok):
                requests[i] = replace(q, lo=q.lo if low_ok else q.floor,
                                      hi=q.hi if high_ok else q.ceiling)
                again.append(i)
                continue
            q = replace(q, floor=q.lo, ceiling=q.hi)
            requests[i] = q
            if count <= policy.max_candidates:
                continue
            slack = 2.0 / policy.accuracy
            left = math.floor(((q.first - below) / count - slack) * policy.grid)
            right = math.ceil(((q.last - below) / count + slack) * policy.grid)
            lo, hi = c.probes[max(0, left)], c.probes[min(policy.grid, right)]
            if (lo, hi) != (q.lo, q.hi):  # unchanged: few distinct values, nothing to gain
                requests[i] = replace(q, lo=lo, hi=hi)
                again.append(i)
        todo = again
    return requests


def interpolated_ranks(fractions: Sequence[float]) -> Ranks:
    """Rank pairs for linearly interpolated quantiles."""
    def ranks(_key: Any, n: int) -> list[tuple[int, int, int]]:
        spots = [p * (n - 1) for p in fractions]
        return [(i, math.floor(h) + 1, math.ceil(h) + 1) for i, h in enumerate(spots)]
    return ranks


def exact_quantiles(long: DataFrame, fractions: Sequence[float], key: str = "variable",
                    value: str = "value",
                    policy: RankPolicy = RankPolicy()) -> dict[Any, list[float]]:
    """Linearly interpolated quantiles per key, exact at any row count."""
    profiles = order_statistics(long, fractions, interpolated_ranks(fractions),
                                key, value, policy)
    out = {}
    for name, p in profiles.items():
        row = []
        for fraction, (a, b) in zip(fractions, p.cuts):
            spot = fraction * (p.n - 1)
            row.append(float(a.value) + (float(b.value) - float(a.value))
                       * (spot - math.floor(spot)))
        out[name] = row
    return out


def approximate_quantiles(long: DataFrame, fractions: Sequence[float], key: str = "variable",
                          value: str = "value", accuracy: int = 10_000) -> dict[Any, list[float]]:
    """One-pass sketch quantiles per key with rank error ``1/accuracy``."""
    rows = long.groupBy(key).agg(
        F.percentile_approx(value, list(fractions), accuracy).alias("q")).collect()
    return {r[key]: [float(q) for q in r.q] for r in rows}


def quantiles(long: DataFrame, fractions: Sequence[float], mode: str = "exact",
              key: str = "variable", value: str = "value",
              policy: RankPolicy = RankPolicy()) -> dict[Any, list[float]]:
    if mode == "exact":
        return exact_quantiles(long, fractions, key, value, policy)
    if mode == "approx":
        return approximate_quantiles(long, fractions, key, value)
    raise ValueError(f"unknown quantile mode {mode!r}")
