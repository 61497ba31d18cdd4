"""Lloyd rounds of many k-means fits over the same rows, by blocks of neighbouring rows.

Rows are dealt once into blocks of rows that lie close together (ranges of a space-filling
curve).  A block knows its rows' bounding box, number and sum.  In a round the distances of the
box to the centroids decide by the triangle inequality which centroids can be nearest to any of
its rows: a centroid whose smallest distance to the box exceeds another one's largest distance is
out.  Where one is left, the block's sum goes to it and no row is looked at; else the rows are
compared with what is left.  Results are those of comparing every row with every centroid.

All fits, whatever their number of clusters and their start, share a round: one scan, and one
small matrix per task, added up in a tree.  Fits that stand still drop out.  Blocks are stored below the
shared folder and cached; a lost executor's blocks are read again.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.workspace import materialise, workers_import

#: Rows of a block, features that order the rows, bits of each of them at most.
ROWS, ORDERING, BITS = 512, 8, 16
#: Rows a start is drawn from, about.
SAMPLE = 4096
#: Rounding allowed for when a centroid is ruled out.
SLACK = 1 + 1e-9
#: Earlier centroids of a fit that new ones are compared with.
LOOK_BACK = 50
#: Partitions whose matrices the driver adds without a tree.
DIRECT = 64

Centroids = np.ndarray
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def curve_place(point: list[Column], centre: list[float], width: list[float]) -> Column:
    """Place of a point on a space-filling curve: the interleaved bits of its coordinates."""
    point = point[:ORDERING]
    bits = min(BITS, 62 // len(point))
    cells = [F.floor(F.lit(float(2 ** bits - 1)) / (1 + F.exp(-(x - c) / w))).cast("long")
             for x, c, w in zip(point, centre, width)]
    parts = [F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1).cast("long")), b * len(cells) + i)
             for i, q in enumerate(cells) for b in range(bits)]
    return reduce(Column.__add__, parts)


def _cut(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in their order to blocks of at most ``size`` rows."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            parts = [x[i:i + size].tobytes() for i in range(0, len(x), size)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["rows"])

    return cut


class Points:
    """The rows of ``df`` as points, in cached blocks until ``release``."""

    def __init__(self, df: DataFrame, point: list[Column], block: int = ROWS) -> None:
        workers_import(df.sparkSession)
        self.size = d = len(point)
        names = [f"x{i}" for i in range(d)]
        salt = F.xxhash64(*df.columns).alias("salt")  # splits equal points over ranges
        rows = df.select(*[p.alias(n) for p, n in zip(point, names)], salt)
        stats = rows.agg(F.count("*"), *[f(n) for n in names for f in (F.avg, F.stddev_pop)]).first()
        self.n = stats[0]
        place = curve_place([F.col(n) for n in names], [stats[1 + 2 * i] or 0.0 for i in range(d)],
                            [stats[2 + 2 * i] or 1.0 for i in range(d)])
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = (rows.withColumn("place", place).repartitionByRange(tasks, "place", "salt")
                 .sortWithinPartitions("place"))
        self.rows = rows
        stored = materialise(dealt.select(*names).mapInArrow(_cut(block), "rows binary"), "blocks")

        def decoded(found: Iterable) -> Iterator[Block]:
            for r in found:
                x = np.frombuffer(r.rows).reshape(-1, d)
                yield x.min(axis=0), x.max(axis=0), np.concatenate([[len(x)], x.sum(axis=0)]), x

        self.blocks: RDD = stored.rdd.mapPartitions(decoded).persist(StorageLevel.MEMORY_AND_DISK)
        self.names = names

    def release(self) -> None:
        self.blocks.unpersist()

    def sample(self, size: int = SAMPLE) -> np.ndarray:
        """About ``size`` rows by their hash, in a fixed order."""
        step = max(1, -(-self.n // size))
        found = self.rows.where(F.pmod(F.xxhash64("salt"), F.lit(step)) == 0).select(*self.names)
        return np.array(sorted(map(tuple, found.collect())), "f8").reshape(-1, self.size)

    def _added(self, partial) -> np.ndarray:
        parts = self.blocks.mapPartitions(partial)
        n = parts.getNumPartitions()
        return parts.treeReduce(np.add, 1 if n <= DIRECT else 2 if n <= DIRECT ** 2 else 3)

    def sums(self, fits: Mapping[Hashable, Centroids]) -> dict[Hashable, np.ndarray]:
        """Per fit and cluster the number of rows and the sums of their coordinates."""
        places = Places(list(fits.values()))

        def partial(blocks: Iterable[Block]) -> Iterator[np.ndarray]:
            yield places.sums(blocks)

        return dict(zip(fits, places.split(self._added(partial))))

    def costs(self, fits: Mapping[Hashable, Centroids]) -> dict[Hashable, float]:
        """Per fit the squared distances of all rows to their nearest centroid."""
        places = Places(list(fits.values()))

        def partial(blocks: Iterable[Block]) -> Iterator[np.ndarray]:
            yield places.costs(blocks)

        return dict(zip(fits, self._added(partial).tolist()))


class Places:
    """The centroids of several fits in one table."""

    def __init__(self, fits: list[Centroids]) -> None:
        self.all = np.concatenate(fits)
        self.sizes = np.array([len(c) for c in fits])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.split(rows, self.starts[1:])

    def possible(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which centroids can be nearest to a point of the box."""
        gap = np.maximum(np.maximum(low - self.all, self.all - high), 0)
        reach = np.maximum(np.abs(self.all - low), np.abs(high - self.all))
        bound = np.minimum.reduceat((reach * reach).sum(axis=1), self.starts)
        return (gap * gap).sum(axis=1) <= np.repeat(bound, self.sizes) * SLACK

    def distances(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the chosen centroids."""
        total = np.zeros((len(x), len(near)))
        for i in range(x.shape[1]):
            off = x[:, i, None] - self.all[near, i]
            total += off * off
        return total

    def sums(self, blocks: Iterable[Block]) -> np.ndarray:
        n, d = self.all.shape
        out = np.zeros((n, d + 1))
        for low, high, total, x in blocks:
            possible = self.possible(low, high)
            left = np.add.reduceat(possible.astype("i8"), self.starts)
            sure = possible & np.repeat(left == 1, self.sizes)
            out[sure] += total
            if (left == 1).all():
                continue
            near = np.flatnonzero(possible & ~sure)
            far = self.distances(x, near)
            ends = np.cumsum(left[left > 1])
            own = np.stack([near[s:e][far[:, s:e].argmin(axis=1)]
                            for s, e in zip([0, *ends[:-1]], ends)])
            flat = own.ravel()
            out[:, 0] += np.bincount(flat, minlength=n)
            for i in range(d):
                out[:, i + 1] += np.bincount(flat, np.tile(x[:, i], len(own)), n)
        return out

    def costs(self, blocks: Iterable[Block]) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        for low, high, _, x in blocks:
            possible = self.possible(low, high)
            near = np.flatnonzero(possible)
            left = np.add.reduceat(possible.astype("i8"), self.starts)
            far = self.distances(x, near)
            out += np.minimum.reduceat(far, np.concatenate([[0], np.cumsum(left)[:-1]]),
                                       axis=1).sum(axis=0)
        return out


def drawn_start(sample: np.ndarray, k: int, seed: tuple[int, ...]) -> Centroids:
    """k rows of a sample, each drawn in proportion to its squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    far = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        weight = far / far.sum() if far.sum() > 0 else None
        chosen.append(sample[rng.choice(len(sample), p=weight)])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def settle(points: Points, starts: Mapping[Hashable, Centroids], still: float,
           max_rounds: int | None = None) -> dict[Hashable, Centroids]:
    """Move the centroids of all fits until they stand still; an unchosen one stays in place.

    A round never makes a fit dearer, so every fit comes to rest; how many rounds that takes grows
    with the number of different rows.  One that comes back to centroids it had before only moves
    by the rounding of its sums and stands still too.  ``max_rounds`` makes more rounds an error.
    """
    fits, moving = dict(starts), list(starts)
    seen = {f: np.empty((0, *c.shape)) for f, c in fits.items()}
    rounds = 0
    while moving:
        if rounds == max_rounds:
            raise RuntimeError(f"{moving} still move after {max_rounds} rounds")
        rounds += 1
        sums = points.sums({f: fits[f] for f in moving})
        for f in list(moving):
            n = sums[f][:, :1]
            after = np.where(n > 0, sums[f][:, 1:] / np.maximum(n, 1), fits[f])
            if not np.isfinite(after).all():
                raise RuntimeError(f"{f} never stands still: a feature is not finite")
            seen[f] = np.concatenate([seen[f][-LOOK_BACK:], fits[f][None]])
            if (np.abs(seen[f] - after).max(axis=(1, 2)) <= still).any():
                moving.remove(f)
            fits[f] = after
    return fits
