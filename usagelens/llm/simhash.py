"""SimHash near-duplicates, found through vantage-point trees.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the hashes of the
text's word shingles.  Two texts are linked if their fingerprints differ in few bits, and a
group is what links connect.

Search.  Two fingerprints that differ in at most ``r`` bits differ in at most ``r // 2`` bits
in their upper or in their lower half.  Each half has its own vantage-point tree, whose nodes
split by the Hamming distance of the half to a vantage point.  By the triangle inequality
the distances of two such halves to any point differ by ``r // 2`` at most, so a branch is
left out unless its shell comes that close; fingerprints just outside a shell also visit the
inner branch.  A shard of the tree therefore holds both ends of every link that it has to
find, and is searched exactly: within a shard only a spanning forest of its links is
returned, so a group of many near copies yields one link per member.

The trees are fitted on a bounded sample of the distinct fingerprints (``SAMPLE`` at most
and an eighth of them at most); every distinct fingerprint is placed in them.

Null and empty texts have the fingerprint zero, which is linked like any other.  Texts with
fewer words than a shingle are one shingle.  Repeated rows share a group.  A null ``doc_id``
counts as none for the group's smallest id; a group without ids has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from usagelens.llm.common import free_name, stored
from usagelens.llm.components import components

WORDS, BITS = 3, 3
#: Distinct fingerprints in a sample for the trees, at most.
SAMPLE = 65_536
#: Fingerprints of a shard before visitors, and of a block searched without a further split.
SHARD, LEAF = 2_000, 4_096


def shingle_hashes(text: str, words: int) -> np.ndarray:
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, "u8")
    joined, words = b" ".join(tokens), min(words, len(tokens))
    sizes = np.fromiter(map(len, tokens), "i8", len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42)
                     for s, e in zip(starts, (ends[words - 1:] - 1).tolist())], "u8")


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed number of 64 bits."""
    hashes = shingle_hashes(text or "", words)
    counts = np.zeros(64, "i8")
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].view("u1").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("i8")[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    @F.arrow_udf(LongType())
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, words) for t in texts.to_pylist()], pa.int64())

    return fingerprints(text)


def _distance(codes: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(codes ^ np.asarray(point, codes.dtype))


class VantageTree:
    """Nested shells around vantage points; ``shards`` says where codes have to be."""

    def __init__(self, sample: np.ndarray, depth: int, reach: int, seed: int = 17) -> None:
        self.reach, self.n_shards = reach, 0
        self.root = self._build(sample, depth, np.random.default_rng(seed))

    def _build(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        split = _split(sample, rng) if depth and len(sample) >= 4 else None
        if split is None:
            self.n_shards += 1
            return self.n_shards - 1
        point, radius = split
        near = _distance(sample, point) <= radius
        return (point, radius, self._build(sample[near], depth - 1, rng),
                self._build(sample[~near], depth - 1, rng))

    def shards(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Shard numbers with the positions of the codes that belong there or visit."""
        todo = [(self.root, np.arange(len(codes)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            point, radius, inner, outer = node
            far = _distance(codes[at], point).astype("i4")
            todo += [(inner, at[far <= radius + self.reach]), (outer, at[far > radius])]


def _split(codes: np.ndarray, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point among the codes and the radius that halves them best."""
    best, found = 0, None
    for point in rng.choice(codes, 4):
        far = _distance(codes, point)
        radius = int(np.median(far))
        for r in (radius - 1, radius):
            near = int((far <= r).sum())
            if min(near, len(codes) - near) > best:
                best, found = min(near, len(codes) - near), (int(point), r)
    return found


def spanning_links(codes: np.ndarray, bits: int, rng: np.random.Generator | None = None
                   ) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links among distinct 64-bit codes."""
    rng = rng or np.random.default_rng(17)
    if len(codes) > LEAF and (split := _split(codes, rng)):
        far = _distance(codes, split[0]).astype("i4")
        parts = [np.flatnonzero(far <= split[1] + bits), np.flatnonzero(far > split[1])]
        if max(map(len, parts)) < 0.85 * len(codes):
            return [(int(p[i]), int(p[j])) for p in parts
                    for i, j in spanning_links(codes[p], bits, rng)]
    linked = np.concatenate([np.empty(0, bool), *[
        (np.bitwise_count(codes[i:i + 256, None] ^ codes[None, :]) <= bits).sum(axis=1) > 1
        for i in range(0, len(codes), 256)]])
    rest, found = np.flatnonzero(linked), []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            close = np.bitwise_count(codes[rest] ^ codes[at]) <= bits
            found += [(int(at), int(x)) for x in rest[close]]
            reached += rest[close].tolist()
            rest = rest[~close]
    return found


def links(fingerprints: DataFrame, bits: int = BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fingerprint``) that connect
    exactly what all links within ``bits`` connect."""
    spark, n = fingerprints.sparkSession, fingerprints.count()
    step = max(8, -(-n // SAMPLE))
    sample = np.array([r[0] for r in fingerprints.where(
        F.pmod(F.xxhash64("fingerprint"), F.lit(step)) == 0).collect()], "i8").view("u8")
    depth = max(0, min(n // SHARD, len(sample) // 8)).bit_length()
    trees = spark.sparkContext.broadcast([
        VantageTree(half, depth, bits // 2)
        for half in ((sample >> np.uint64(32)).astype("u4"), sample.astype("u4"))])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["fingerprint"].to_numpy(zero_copy_only=False)
            whole = codes.view("u8")
            halves = ((whole >> np.uint64(32)).astype("u4"), whole.astype("u4"))
            for t, (tree, half) in enumerate(zip(trees.value, halves)):
                for shard, at in tree.shards(half):
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(np.full(len(at), 2 * shard + t, "i8")),
                        "fingerprint": pa.array(codes[at])})

    def searched(shard: pa.Table) -> pa.Table:
        codes = np.unique(shard["fingerprint"].to_numpy())
        found = np.array(spanning_links(codes.view("u8"), bits), "i8").reshape(-1, 2)
        return pa.table({"a": codes[found[:, 0]], "b": codes[found[:, 1]]})

    return (fingerprints.select("fingerprint").mapInArrow(placed, "shard long, fingerprint long")
            .groupBy("shard").applyInArrow(searched, "a long, b long"))


def grouped(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Add ``component_id``, the smallest ``doc_id`` of the group, and ``root``, a fingerprint
    that names the group, to rows with ``doc_id`` and ``fingerprint``.

    ``rows`` should be a stored table, it is read twice.
    """
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    roots = stored(components(links(classes, bits)), "roots")
    linked = roots.join(classes, roots["node"] == classes["fingerprint"])
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    # stored, so that the last join is between two exchanges and a hot class can be split
    groups = stored(classes.join(
        roots.join(least, "root").select(F.col("node").alias("fingerprint"), "root", "least"),
        "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"),
        F.coalesce("least", "first").alias("component_id")), "groups")
    return rows.join(groups, "fingerprint")


def near_duplicates(documents: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    rows = documents.select("doc_id", fingerprint(F.col("text"), words).alias("fingerprint"))
    return (grouped(stored(rows, "fingerprints"), bits)
            .select("doc_id", "fingerprint", "component_id"))


def one_per_group(documents: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id.

    One of several rows with the smallest id stays, and one row of a group without ids.
    """
    code = free_name(documents.columns, "fingerprint")
    row = free_name([*documents.columns, code], "row_number")
    marked = stored(documents.withColumns({
        code: fingerprint(F.col("text"), words), row: F.monotonically_increasing_id()}), "marked")
    prints = marked.select("doc_id", F.col(row).alias("row"), F.col(code).alias("fingerprint"))
    kept = (grouped(prints, bits).groupBy("root")
            .agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("first"))
            .select(F.col("first.row").alias(row)))
    return marked.join(kept, row, "left_semi").select(*documents.columns)
