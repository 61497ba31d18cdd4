"""Shards by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions, racks and shards.  Every row draws a number at
every shard, exponentially distributed with the shard's weight as its rate; a rack's or a
region's draw is the smallest one below it, which makes it exponential with the weight of
the whole subtree.  The row descends: the region with the smallest draw, in it the rack, in
it the shard.

The draws depend on the row's key and the shard alone.  A change of one weight therefore
alters draws on one path only: rows move into or out of that subtree and nowhere else, and a
new shard takes rows only into itself (law ``key``).

DataFrame functions only.  Null keys are one key.  Repeated rows go to the same shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.llm.common import stored, whole_text


@dataclass(frozen=True)
class Tree:
    """Weights of the shards, filled rack by rack and region by region."""

    weights: Sequence[float]
    rack_shards: int = 4
    region_racks: int = 4

    @staticmethod
    def even(shards: int) -> Tree:
        return Tree((1.0,) * shards)

    def regions(self) -> list[list[list[int]]]:
        n = len(self.weights)
        racks = [list(range(i, min(i + self.rack_shards, n)))
                 for i in range(0, n, self.rack_shards)]
        return [racks[i:i + self.region_racks] for i in range(0, len(racks), self.region_racks)]


#: A draw's uniform number has so many hexadecimal digits of a digest (52 bits).
DIGITS = 13


def shard_draws(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The row's exponential draws at shards with weights; a weight of zero never wins."""
    name = F.coalesce(key.cast("string"), F.lit(""))

    def draw(shard: Column) -> Column:
        digest = F.md5(F.concat_ws(":", name, shard["shard"].cast("string")))
        whole = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
        return -F.log((whole + 0.5) / 16.0 ** DIGITS) / shard["weight"]

    return F.transform(F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(1.0 * w if w > 0 else 1e-300)
                                          .alias("weight")) for s, w in shards]), draw)


def _spans(sizes: Sequence[int]) -> list[tuple[int, int]]:
    """First position (from 1) and length of groups that lie one behind the other."""
    ends = [sum(sizes[:i]) for i in range(len(sizes))]
    return [(e + 1, n) for e, n in zip(ends, sizes)]


def _best_below(draws: Column, spans: Sequence[tuple[int, int]]) -> Column:
    """The smallest draw of each group."""
    groups = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(n).alias("n")) for a, n in spans])
    return F.transform(groups, lambda g: F.array_min(F.slice(draws, g["at"], g["n"])))


def _choose(draws: Column, spans: Sequence[tuple[int, int]], group: Column) -> Column:
    """Position (from 1) of the smallest draw within a group given by its position."""
    at = F.get(F.array(*[F.lit(a) for a, _ in spans]), group - 1)
    size = F.get(F.array(*[F.lit(n) for _, n in spans]), group - 1)
    own = F.slice(draws, at, size)
    return (at + F.array_position(own, F.array_min(own)) - 1).cast("int")


def place(df: DataFrame, key: str, tree: Tree, grown: Tree | None = None,
          shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """Add the shard of each row, and its shard in a second tree that shares the draws."""
    trees = {shard: tree} | ({grown_shard: grown} if grown else {})
    wanted = sorted({(s, float(w)) for t in trees.values() for s, w in enumerate(t.weights)})
    at = {pair: i for i, pair in enumerate(wanted)}
    steps = df.select(F.struct(*df.columns).alias("row"),
                      shard_draws(F.col(key), wanted).alias("draws"))
    for k, t in enumerate(trees.values()):
        own = F.array(*[F.lit(at[s, float(w)]) for s, w in enumerate(t.weights)])
        regions = t.regions()
        in_rack = _spans([len(rack) for region in regions for rack in region])
        in_region = _spans([len(region) for region in regions])
        leaf, rack, region = F.col(f"leaf{k}"), F.col(f"rack{k}"), F.col(f"region{k}")
        steps = (steps.withColumn(f"leaf{k}", F.transform(own, lambda i: F.get("draws", i)))
                 .withColumn(f"rack{k}", _best_below(leaf, in_rack))
                 .withColumn(f"region{k}", _best_below(rack, in_region))
                 .withColumn(f"region_no{k}", _choose(region, [(1, len(regions))], F.lit(1)))
                 .withColumn(f"rack_no{k}", _choose(rack, in_region, F.col(f"region_no{k}")))
                 .withColumn(f"shard_no{k}", _choose(leaf, in_rack, F.col(f"rack_no{k}")) - 1))
    return steps.select(*[F.col("row").getField(c).alias(c) for c in df.columns],
                        *[F.col(f"shard_no{k}").alias(n) for k, n in enumerate(trees)])


def slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    The rows are stored with the task that wrote them.  A row's slot is its number within
    shard and task plus the rows of the shard in earlier tasks, so no task ever holds a
    shard: the largest group is one task's share.
    """
    kept = stored(df.withColumns({"_task": F.spark_partition_id(),
                                  "_row": F.monotonically_increasing_id()}), "shards")
    counts = kept.groupBy(shard, "_task").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_task",
                            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(shard, "_task").orderBy("_row")) - 1
    return (kept.withColumn("_within", within).join(offsets, [shard, "_task"])
            .select(*df.columns, (F.col("_before") + F.col("_within")).alias(slot)))


def shard_documents(documents: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row."""
    text = F.encode(whole_text(), "UTF-8")
    rows = documents.select("doc_id", (F.octet_length(whole_text()) + 16).cast("long")
                            .alias("size"), F.crc32(text).alias("text_crc32"))
    return slots(place(rows, "doc_id", tree, grown))


def balance(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def moved(sharded: DataFrame) -> DataFrame:
    """Rows by the shard they leave and the shard they go to when the tree grows."""
    return (sharded.where("shard <> grown_shard").groupBy("shard", "grown_shard")
            .agg(F.count("*").alias("rows")))
