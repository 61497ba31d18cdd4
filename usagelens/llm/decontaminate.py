"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-case words (letters and digits).  Runs of ``MATCH`` words of the
benchmark items, hashed by a rolling Karp-Rabin function, are the seeds; a document that
shares a seed with an item is tiled against it.  Tiling marks the longest match of unmarked
words first and goes on until no match of ``MATCH`` words is left, so a passage counts in any
order of its parts.  A document is contaminated by an item if the tiles cover at least
``COVERAGE`` of the item's words.

Documents never meet: each is checked where it is read, against an index of the benchmark
that is broadcast.  The index holds ``BLOCK_BYTES`` of item texts at most; a larger benchmark
is split by hash into more blocks and the documents are read once per block.

Null and empty documents, and items without words, match nothing.  An item of fewer than
``MATCH`` words matches as one whole run.  Repeated rows are reported as often as they occur.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.common import whole_text

MATCH, COVERAGE = 5, 0.5
BLOCK_BYTES = 32 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W_]+")
#: What stands before the first word of an item: no word of a text.
ITEM_START = -5
RESULT = "doc_id long, item_id long, n_tiles long, covered long, coverage double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``length`` ids, modulo 2**64."""
    n = len(ids) - length + 1
    total = np.zeros(max(0, n), "u8")
    if n > 0:
        for i in range(length):
            total = total * BASE + ids[i:i + n].astype("u8") + np.uint64(1)
    return total


class Benchmark:
    """Items as sequences of word numbers, and where each seed occurs in them."""

    def __init__(self, items: Iterable[tuple], match: int = MATCH) -> None:
        """Items are ``(item_id, text)`` or ``(item_id, text, number of equal rows)``."""
        self.match, self.word = match, {}
        self.items: list[tuple[int | None, np.ndarray, int]] = []
        # per seed the word before it, its item and its place, in this order
        seeds: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(
            lambda: defaultdict(list))
        for item_id, text, *rows in items:
            ids = np.array([self.word.setdefault(w, len(self.word)) for w in words_of(text)], "i8")
            if len(ids):
                length = min(match, len(ids))
                before = [ITEM_START, *ids[:-1].tolist()]
                for at, seed in enumerate(rolling(ids, length).tolist()):
                    seeds[length][seed].append((before[at], len(self.items), at))
                self.items.append((item_id, ids, rows[0] if rows else 1))
        self.sorted = {n: np.array(sorted(s), "u8") for n, s in seeds.items()}
        self.seeds = {n: {k: sorted(v) for k, v in s.items()} for n, s in seeds.items()}

    def found(self, text: str) -> Iterator[tuple[int | None, int, int, float]]:
        """Item, number of tiles, covered words and coverage, for every row of a matched item."""
        for *match, n in self.matched(text):
            yield from repeat(tuple(match), n)

    def matched(self, text: str) -> Iterator[tuple[int | None, int, int, float, int]]:
        """Item, number of tiles, covered words, coverage and rows of items that share a seed.

        Only seeds at which a match begins are listed, those whose words before them differ, so
        a word that text and item repeat does not list every pair of its places.
        """
        words = words_of(text)
        ids = np.fromiter(map(self.word.get, words, repeat(-1)), "i8", len(words))
        matches: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length, known in self.sorted.items():
            inside = np.convolve(ids >= 0, np.ones(length, "i4"), "valid") == length \
                if len(ids) >= length else np.zeros(0, bool)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            seed = rolling(ids, length)[at]
            place = np.minimum(np.searchsorted(known, seed), len(known) - 1)
            for p, s in zip(at[known[place] == seed].tolist(),
                            seed[known[place] == seed].tolist()):
                entries, before = self.seeds[length][s], int(ids[p - 1]) if p else -1
                low = bisect_left(entries, (before,))
                high = bisect_left(entries, (before + 1,), low)
                for _, item, q in chain(entries[:low], entries[high:]):
                    matches[item].append((p, q))
        for item, starts in matches.items():
            item_id, own, n = self.items[item]
            tiles = tile(ids, own, starts, min(self.match, len(own)))
            covered = sum(size for _, _, size in tiles)
            if covered:
                yield item_id, len(tiles), covered, covered / len(own), n


def maximal_matches(ids: np.ndarray, own: np.ndarray, starts: list[tuple[int, int]], match: int
                    ) -> list[tuple[int, int, int]]:
    """Matches from where they start to where text and item part; hash collisions are too short."""
    out = []
    for p, q in starts:
        n = min(len(ids) - p, len(own) - q)
        apart = ids[p:p + n] != own[q:q + n]
        end = int(apart.argmax())
        size = end if apart[end] else n
        if size >= match:
            out.append((p, q, size))
    return out


def tile(ids: np.ndarray, own: np.ndarray, starts: list[tuple[int, int]], match: int
         ) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, length), longest first.

    Among equally long matches the one that is first in the item, then in the document.  A
    match that runs into marked words goes back as its unmarked parts.
    """
    in_text, in_item = np.zeros(len(ids), bool), np.zeros(len(own), bool)
    heap = [(-n, q, p) for p, q, n in maximal_matches(ids, own, starts, match)]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        taken = in_text[p:p + n] | in_item[q:q + n]
        if not taken.any():
            in_text[p:p + n] = in_item[q:q + n] = True
            tiles.append((p, q, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype("i1")))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= match:
                heapq.heappush(heap, (a - b, q + a, p + a))
    return tiles


def blocks_of(benchmark: DataFrame, match: int = MATCH, block_bytes: int = BLOCK_BYTES
              ) -> Iterator[Benchmark]:
    """The benchmark in blocks small enough to broadcast; equal rows are one with their number."""
    items = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id"),
                              whole_text().alias("text")).agg(F.count("*").alias("n"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield Benchmark(sorted(map(tuple, part), key=lambda r: (r[0] is None, r)), match)


def contaminations(documents: DataFrame, benchmark: DataFrame, match: int = MATCH,
                   coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, n_tiles, covered, coverage`` of every contaminated document."""
    spark, parts = documents.sparkSession, []
    for block in blocks_of(benchmark, match):
        index = spark.sparkContext.broadcast(block)

        def checked(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *f) for d, t in zip(batch["doc_id"].to_pylist(),
                                                batch["text"].to_pylist())
                        for f in index.value.matched(t) if f[3] >= coverage]
                columns = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_pydict({
                    n: pa.array(c, pa.float64() if n == "coverage" else pa.int64())
                    for n, c in zip(("doc_id", "item_id", "n_tiles", "covered", "coverage", "n"),
                                    columns)})

        once = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                                whole_text().alias("text")).mapInArrow(checked, f"{RESULT}, n long")
        parts.append(once.select(*once.columns[:-1], F.explode(F.sequence(F.lit(1).cast("long"), "n")))
                     .drop("col"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def _leaks(text: Column, index: Broadcast, coverage: float) -> Column:
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        return pa.array([any(f[3] >= coverage for f in index.value.matched(t or ""))
                         for t in texts.to_pylist()], pa.bool_())

    return leaks(text)


def clean(documents: DataFrame, benchmark: DataFrame, match: int = MATCH,
          coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates."""
    for block in blocks_of(benchmark, match):
        index = documents.sparkSession.sparkContext.broadcast(block)
        documents = documents.where(~_leaks(F.col("text"), index, coverage))
    return documents
