"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return (joined.select("a", F.col("m").alias("b"))
            .union(joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links(a, b)``; the root is the smallest node reachable.

    Every round shortens the paths by a constant factor and is stored; rounds end when the
    table of links stands still, each node then pointing at its root.  Only two numbers per
    round reach the driver.  Links of a node to itself, repeated links and null ends are
    ignored: a node that has no other link is not in the result.
    """
    ordered = (links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                            F.least("a", "b").alias("b")).distinct())
    now, mark = stored(ordered, "links"), None
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark or seen[0] == 0:
            break
        mark, now = seen, stored(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("b").alias("node")).distinct()
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(roots.select("node", F.col("node").alias("root"))))
