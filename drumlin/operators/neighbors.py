"""Neighbour search as joins: radius pairs, nearest neighbours, core distances.

Three providers give the same pairs. `blocks` broadcasts the cloud as a matrix, in parts of
BLOCK_BYTES, and computes distances in NumPy, a bounded piece at a time: within
neighbouring cells up to three axes, behind a matrix product in more. `grid` files points
under cells of the radius' width along up to three axes and joins each cell with its
neighbours: two points within the radius differ by at most one cell along any axis, so it
is exact in any dimension and never compares far pairs. `nested` is the plain theta join,
for checks. `pivots` is approximate: it looks into the cells of the nearest of some chosen
points, as many as a sample needs for the recall asked for. A hot cell is split by Spark's skew handling; exact copies are best merged
beforehand (prep.deduplicate)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drumlin.functions import vectors as V
from drumlin.schema import dimension, weight
from drumlin.store import written

BLOCK_BYTES = 64_000_000
GRID_AXES = 3
ALL_PAIRS = 20_000_000_000


#: Distances that a task holds at once.
HELD_CELLS = 2_000_000
#: Points of the cloud in one product, and pairs that go to Spark at once.
PRODUCT_COLUMNS, SENT_PAIRS = 2048, 100_000
#: Rows on which an index measures its recall, at least and at most, and the least pairs for it.
SAMPLE_ROWS, SAMPLE_PAIRS = (512, 4096), 1000


class NeighborProvider(Protocol):
    """What a neighbour source has to offer: pairs (i, j, d2) within the radius, i = j included."""

    def __call__(self, points: DataFrame, radius: float, closed: bool) -> DataFrame: ...


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, summed axis by axis."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


def matrix_of(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and coordinates of a cloud that has been found small enough, by id."""
    frame = points.select("point_id", "x").toPandas().sort_values("point_id")
    return frame["point_id"].to_numpy(dtype=np.int64), np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), -1 if len(frame) else 0)


def matrix_by_arrow(points: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """As matrix_of(), of a cloud whose one dimension is known, without a Python object a number."""
    t = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("x").cast("array<double>").alias("x")).toArrow()
    ids = t["point_id"].to_numpy()
    cloud = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in t["x"].chunks)]).reshape(len(ids), dim)
    order = np.argsort(ids)
    return ids[order], cloud[order]


def fits_broadcast(points: DataFrame, dim: int) -> bool:
    return points.count() * dim * 8 <= BLOCK_BYTES


def parts_of(points: DataFrame, dim: int) -> list[DataFrame]:
    """The cloud in as few parts as fit a broadcast, dealt by a hash of the id."""
    n = -(-points.count() * dim * 8 // BLOCK_BYTES)
    return [points] if n <= 1 else [points.where(F.pmod(F.xxhash64("point_id"), F.lit(n)) == k) for k in range(n)]


def cells_prune(points: DataFrame, radius: float, dim: int) -> bool:
    """Whether pairs_grid() has cells enough that most are no neighbours."""
    spans = points.agg(*(F.max(F.col("x")[k]) - F.min(F.col("x")[k]) for k in range(dim))).first()
    widest = sorted((s or 0.0 for s in spans), reverse=True)[:GRID_AXES]
    return radius <= 0 or float(np.prod([s / radius + 1 for s in widest])) > 2 * 3 ** len(widest)


def pairs_nested(points: DataFrame, radius: float, closed: bool = False) -> DataFrame:
    dim = dimension(points)
    a, b = points.select(F.col("point_id").alias("i"), F.col("x").alias("__a")), points.select(F.col("point_id").alias("j"), F.col("x").alias("__b"))
    d2, r2 = V.square_dist(F.col("__a"), F.col("__b"), dim), radius * radius
    return a.join(b, (d2 <= r2) if closed else (d2 < r2)).select("i", "j", V.square_dist(F.col("__a"), F.col("__b"), dim).alias("d2"))


def pairs_equal(points: DataFrame) -> DataFrame:
    """Pairs at distance 0, an equality join."""
    a, b = points.select(F.col("point_id").alias("i"), F.transform("x", lambda v: v.cast("double") + F.lit(0.0)).alias("k")), points.select(F.col("point_id").alias("j"), F.transform("x", lambda v: v.cast("double") + F.lit(0.0)).alias("k"))
    return a.join(b, "k").select("i", "j", F.lit(0.0).alias("d2"))


def pairs_grid(points: DataFrame, radius: float, closed: bool = False, asked: DataFrame | None = None) -> DataFrame:
    dim = dimension(points)
    if radius <= 0:
        return pairs_equal(points) if closed else points.select(F.col("point_id").alias("i"), F.col("point_id").alias("j"), F.lit(0.0).alias("d2")).limit(0)
    spans = points.agg(*(F.max(F.col("x")[k]) - F.min(F.col("x")[k]) for k in range(dim))).first()
    axes = sorted(range(dim), key=lambda k: -(spans[k] or 0))[:GRID_AXES]
    width = radius * (1 + 1e-9)  # a pair on the boundary never skips a cell by rounding
    cells = [F.floor(F.col("x")[k].cast("double") / width).alias(f"c{n}") for n, k in enumerate(axes)]
    filed = points.select(F.col("point_id").alias("j"), F.col("x").alias("__b"), *cells)
    offsets = F.array(*(F.struct(*(F.lit(o).cast("long").alias(f"o{n}") for n, o in enumerate(os))) for os in product((-1, 0, 1), repeat=len(axes))))
    own = points if asked is None else points.join(asked.select("point_id"), "point_id", "left_semi")
    spread = own.select(F.col("point_id").alias("i"), F.col("x").alias("__a"), *cells).withColumn("o", F.explode(offsets))
    spread = spread.select("i", "__a", *((F.col(f"c{n}") + F.col(f"o.o{n}")).alias(f"c{n}") for n in range(len(axes))))
    d2, r2 = V.square_dist(F.col("__a"), F.col("__b"), dim), radius * radius
    joined = spread.join(filed, [f"c{n}" for n in range(len(axes))]).select("i", "j", d2.alias("d2"))
    return joined.where((F.col("d2") <= r2) if closed else (F.col("d2") < r2))


class Screen:
    """Pairs that can be within the radius, by one product: (x, 1) * (y, -|y|^2 / 2) is at least
    (|x|^2 - r^2) / 2, less the product's error. In single precision where that error is small
    beside the radius."""

    def __init__(self, cloud: np.ndarray, radius: float):
        norms = np.einsum("ij,ij->i", cloud, cloud)
        self.r2, self.top, self.kind = radius * radius, float(norms.max(initial=0.0)), np.float32
        self.terms = cloud.shape[1] + 8
        if not (1e-30 < self.r2 and self.top < 1e30 and self._slack(self.top) <= 0.01 * self.r2):
            self.kind = np.float64
        self.right = np.hstack([cloud, norms[:, None] / -2]).astype(self.kind)

    def _slack(self, own2):
        return 4 * float(np.finfo(self.kind).eps) * self.terms * (own2 + self.top + self.r2)

    def near(self, x: np.ndarray, begin: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of x, row of the cloud) with the latter from begin to end, a bounded piece at a time."""
        own2 = np.einsum("ij,ij->i", x, x)
        left = np.hstack([x, np.ones((len(x), 1))]).astype(self.kind)
        least = ((own2 - self.r2) / 2 - self._slack(own2)).astype(self.kind)[:, None]
        end = len(self.right) if end is None else end
        for c in range(begin, end, PRODUCT_COLUMNS):
            right = self.right[c : min(end, c + PRODUCT_COLUMNS)].T
            n = right.shape[1]
            step = max(1, HELD_CELLS // n)
            for at in range(0, len(x), step):
                found = np.flatnonzero(left[at : at + step] @ right >= least[at : at + step])
                if len(found):
                    yield at + found // n, c + found % n


def exact(x: np.ndarray, cloud: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows i of x to rows j of the cloud, summed axis by axis, as everywhere."""
    d2 = np.zeros(len(i))
    for at in range(0, len(i), step := max(1, PRODUCT_COLUMNS * 64 // max(x.shape[1], 1))):
        d = x[i[at : at + step]] - cloud[j[at : at + step]]
        for axis in range(d.shape[1]):
            d2[at : at + step] += d[:, axis] * d[:, axis]
    return d2


def sent(pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Pieces (i, j, d2) as frames of some SENT_PAIRS rows."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= SENT_PAIRS:
            yield pd.DataFrame(dict(zip(("i", "j", "d2"), map(np.concatenate, zip(*held, strict=True)), strict=True)))
            held, n = [], 0
    if n:
        yield pd.DataFrame(dict(zip(("i", "j", "d2"), map(np.concatenate, zip(*held, strict=True)), strict=True)))


def searched(points: DataFrame, radius: float, closed: bool, asked: DataFrame | None, held: Broadcast, near: Callable) -> DataFrame:
    """(i, j, d2) of the points in a broadcast (ids, cloud, ...): near(x, *held) gives the rows of
    x and of the cloud that may be within the radius; exact distances decide."""
    r2 = radius * radius

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, cloud, *more = held.value
        screen = Screen(cloud, radius)

        def pieces():
            for frame in frames:
                x, own = np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), -1), frame["point_id"].to_numpy()
                for i, j in near(screen, x, *more):
                    d2 = exact(x, cloud, i, j)
                    keep = d2 <= r2 if closed else d2 < r2
                    yield own[i[keep]], ids[j[keep]], d2[keep]

        yield from sent(pieces())

    return dealt(points, asked).mapInPandas(run, "i long, j long, d2 double")


def dealt(points: DataFrame, asked: DataFrame | None) -> DataFrame:
    """The points asked, dealt out to all cores: work grows with the pairs, not with the rows' bytes."""
    chosen = points if asked is None else points.join(asked.select("point_id"), "point_id", "left_semi")
    return chosen.select("point_id", "x").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "point_id")


def pairs_blocks(points: DataFrame, radius: float, closed: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """Pairs by a broadcast matrix, a bounded piece of distances at a time. Up to GRID_AXES axes
    points are compared within neighbouring cells, copies as one. In more, a matrix product finds what can be
    within the radius, by its error bound, and exact distances decide; a cloud over BLOCK_BYTES
    is searched part by part."""
    dim = dimension(points)
    spread = points.sparkSession.sparkContext.broadcast
    if dim > GRID_AXES:
        return reduce(DataFrame.union, (searched(points, radius, closed, asked, spread(matrix_by_arrow(p, dim)), Screen.near) for p in parts_of(points, dim)))
    ids, cloud = matrix_by_arrow(points, dim)
    if not len(ids) or radius <= 0:
        return searched(points, radius, closed, asked, spread((ids, cloud)), Screen.near)
    wanted = None if asked is None else asked.select(F.col("point_id").cast("long")).dropna().toArrow()["point_id"].to_numpy()
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = spread(Places(ids, cloud, radius, wanted, tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch["id"].to_pylist():
                yield from held.value.near(task, closed)

    near = points.sparkSession.range(0, tasks, 1, tasks).mapInArrow(run, "i array<long>, j array<long>, d2 array<double>")
    near = near.select("i", "d2", F.posexplode("j").alias("at", "j")).select("i", "j", F.get("d2", "at").alias("d2"))
    return near.select(F.explode("i").alias("i"), "j", "d2")


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of each k, counts[k] of them."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))


class Places:
    """The distinct points of a cloud of few axes in the order of their cells, each with the ids
    of its copies, and the copies asked in slices of about equal work, one for each task.

    A distance is computed once for all copies of both points. Copies are sent as two lists, of
    which Spark makes the pairs; a place's pairs come together, so a column's values are few or
    repeat and the result is stored in little space."""

    def __init__(self, ids: np.ndarray, cloud: np.ndarray, radius: float, asked: np.ndarray | None, tasks: int):
        order = np.lexsort((ids, *cloud.T, CellRuns(cloud, radius).codes(cloud)))
        ids, cloud = ids[order], cloud[order]
        first = np.flatnonzero(np.append(True, (cloud[1:] != cloud[:-1]).any(axis=1)))
        copies = np.diff(np.append(first, len(ids)))
        self.ids, self.first, self.copies, self.r2 = ids, first, copies, radius * radius
        self.cells = CellRuns(cloud[first], radius)
        own = np.repeat(np.arange(len(first), dtype=np.int32), copies)
        chosen = np.ones(len(ids), dtype=bool) if asked is None else np.isin(ids, asked)
        self.own, self.own_ids = own[chosen], ids[chosen]
        work = np.cumsum(self.cells.crowd(copies + 1)[self.own])
        self.cuts = np.searchsorted(work, np.arange(1, tasks) / tasks * (work[-1] if len(work) else 0))
        self.cuts = np.concatenate([[0], self.cuts, [len(self.own)]])

    def near(self, task: int, closed: bool) -> Iterator[pa.RecordBatch]:
        """Batches of (i, j, d2): each id of i pairs with each of j, at the distance d2 of the latter."""
        begin, end = self.cuts[task : task + 2]
        own = self.own[begin:end]
        if not len(own):
            return
        # Copies of a place that go together, SENT_PAIRS at most.
        runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sizes = np.diff(np.append(runs, len(own)))
        pieces = -(-sizes // SENT_PAIRS)
        starts = runs.repeat(pieces) + SENT_PAIRS * spans(np.zeros(len(runs), dtype=np.int64), pieces)
        counts = np.diff(np.append(starts, len(own)))
        for i, j, d2 in self.cells.near(self.cells.cloud[own[starts]]):
            keep = np.flatnonzero(d2 <= self.r2 if closed else d2 < self.r2)
            i, j, d2 = i[keep], j[keep], d2[keep]
            ends = np.cumsum(self.copies[j])
            for at in range(0, ends[-1] if len(ends) else 0, SENT_PAIRS):
                a, b = np.searchsorted(ends, (at, min(at + SENT_PAIRS, ends[-1]) - 1), "right") + (0, 1)
                low = np.maximum(ends[a:b] - self.copies[j[a:b]], at)
                n = np.minimum(ends[a:b], at + SENT_PAIRS) - low
                skipped = low - (ends[a:b] - self.copies[j[a:b]])
                rows = np.flatnonzero(np.append(True, i[a + 1 : b] != i[a : b - 1]))
                mine, sums = i[a:b][rows], np.add.reduceat(n, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        lists(self.own_ids[spans(begin + starts[mine], counts[mine])], counts[mine]),
                        lists(self.ids[spans(self.first[j[a:b]] + skipped, n)], sums),
                        lists(d2[a:b].repeat(n), sums),
                    ],
                    ["i", "j", "d2"],
                )


class Pivots:
    """A cloud filed under the nearest of about 2 sqrt(n) of its points. A point is compared with
    the cells of its `looks` nearest pivots: as few as reach the recall on a sample of the cloud's
    points, by brute force over all of it. Points count by their weights, in the sample too;
    copies don't count, as they are never missed."""

    def __init__(self, cloud: np.ndarray, radius: float, recall: float, weights: np.ndarray | None = None, seed: int = 42):
        rng, n = np.random.default_rng(seed), len(cloud)
        self.at = np.unique(cloud[rng.choice(n, min(n, int(2 * n**0.5) + 1), replace=False)], axis=0)
        self.half = np.einsum("ij,ij->i", self.at, self.at) / 2
        own = np.concatenate([np.zeros(0, dtype=np.int64), *(self._closeness(cloud[k : k + 2048]).argmax(axis=1) for k in range(0, n, 2048))])
        self.order = np.argsort(own, kind="stable")
        self.starts = np.searchsorted(own[self.order], np.arange(len(self.at) + 1))
        sample = rng.permutation(n)[: SAMPLE_ROWS[1]] if weights is None else rng.choice(n, SAMPLE_ROWS[1], p=weights / weights.sum())
        self.looks = self._looks(cloud, own, radius, recall, sample, np.ones(n) if weights is None else weights)

    def _closeness(self, x: np.ndarray) -> np.ndarray:
        return x @ self.at.T - self.half

    def _looks(self, cloud: np.ndarray, own: np.ndarray, radius: float, recall: float, sample: np.ndarray, weights: np.ndarray) -> int:
        """The least number of cells whose recall is reached less two standard errors, from row to
        row; all cells where the sample has too few pairs to tell."""
        screen, found, pairs = Screen(cloud, radius), [], 0
        for k in range(0, len(sample), SAMPLE_ROWS[0]):
            x = cloud[sample[k : k + SAMPLE_ROWS[0]]]
            rank = np.argsort(np.argsort(-self._closeness(x), axis=1), axis=1)
            by_rank = np.zeros(rank.shape)
            for i, j in screen.near(x):
                d2 = exact(x, cloud, i, j)
                keep = (d2 <= radius * radius) & (d2 > 0)
                np.add.at(by_rank, (i[keep], rank[i[keep], own[j[keep]]]), weights[j[keep]])
                pairs += int(keep.sum())
            found.append(by_rank.cumsum(axis=1))
            if pairs >= SAMPLE_PAIRS:
                break
        if pairs < SAMPLE_PAIRS:
            return len(self.at)
        by_rank = np.concatenate(found)
        total = by_rank[:, -1].sum()
        share = by_rank.sum(axis=0) / total
        error = np.sqrt(((by_rank - share * by_rank[:, -1:]) ** 2).sum(axis=0)) / total
        return max(2, int(np.argmax(share - 2 * error >= recall)) + 1)  # two: rounding may swap the nearest

    def near(self, screen: Screen, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As Screen.near(), of a cloud in the order of its cells."""
        for at in range(0, len(x), step := max(1, HELD_CELLS // len(self.at))):
            looks = np.ones((len(x[at : at + step]), len(self.at)), dtype=bool)
            if self.looks < len(self.at):
                close = self._closeness(x[at : at + step])
                looks[:] = False
                np.put_along_axis(looks, np.argpartition(-close, self.looks - 1, axis=1)[:, : self.looks], True, axis=1)
            for c in range(len(self.at)):
                rows = at + np.flatnonzero(looks[:, c])
                if len(rows):
                    for i, j in screen.near(x[rows], self.starts[c], self.starts[c + 1]):
                        yield rows[i], j


def near_by_pivots(screen: Screen, x: np.ndarray, pivots: Pivots) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return pivots.near(screen, x)


def pairs_pivots(points: DataFrame, radius: float, closed: bool = True, asked: DataFrame | None = None, recall: float = 0.95) -> DataFrame:
    """Approximate pairs by an index of pivots. Every pair returned is right; no more than the
    share 1 - recall is missed, as measured when the index is built. A cloud over BLOCK_BYTES
    has an index for each part."""

    dim = dimension(points)

    def of(part: DataFrame) -> DataFrame:
        ids, cloud = matrix_by_arrow(part, dim)
        if not len(ids):
            return searched(points, radius, closed, asked, points.sparkSession.sparkContext.broadcast((ids, cloud)), Screen.near)
        weights = part.select("point_id", F.col("w").cast("double")).toPandas().sort_values("point_id")["w"].to_numpy() if "w" in part.columns else None
        pivots = Pivots(cloud, radius, recall, weights)
        order, pivots.order = pivots.order, None
        return searched(points, radius, closed, asked, points.sparkSession.sparkContext.broadcast((ids[order], cloud[order], pivots)), near_by_pivots)

    return reduce(DataFrame.union, map(of, parts_of(points, dim)))


class CellRuns:
    """A cloud of few axes sorted by cells of the radius' width: the neighbours of a cell are
    one run of the sorted points for each neighbouring row of cells."""

    def __init__(self, cloud: np.ndarray, radius: float):
        self.cloud, self.width = cloud, radius * (1 + 1e-6)
        keys = np.floor(cloud / self.width)
        self.low, self.axes, self.cells = keys.min(axis=0) - 1, [], []
        for k in range(cloud.shape[1]):  # an axis whose cells can't be told apart or numbered is left out
            n = keys[:, k].max() - self.low[k] + 2
            if np.abs(keys[:, k]).max() < 2.0**31 and np.prod([*self.cells, n]) < 2.0**62:
                self.axes.append(k)
                self.cells.append(int(n))
        code = self.codes(cloud)
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]

    def codes(self, x: np.ndarray) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for k, n in zip(self.axes, self.cells, strict=True):
            code = code * n + (np.floor(x[:, k] / self.width) - self.low[k]).astype(np.int64)
        return code

    def _runs(self, at):
        """Bounds in the sorted cloud of the runs next to the cell (or cells) `at`."""
        steps = [int(np.prod(self.cells[k + 1 :])) for k in range(len(self.cells) - 1)]
        shifts = [sum(o * n for o, n in zip(os, steps, strict=True)) for os in product((-1, 0, 1), repeat=len(steps))]
        return [(np.searchsorted(self.code, at + s - 1, "left"), np.searchsorted(self.code, at + s + 1, "right")) for s in shifts]

    def crowd(self, weights: np.ndarray) -> np.ndarray:
        """For each row of the cloud the weight in its cell and the neighbouring ones."""
        sums = np.append(0, np.cumsum(weights[self.order]))
        cells, cell = np.unique(self.code, return_inverse=True)
        out = np.empty(len(self.code), dtype=np.int64)
        out[self.order] = sum(sums[hi] - sums[lo] for lo, hi in self._runs(cells))[cell]
        return out

    def near(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of x, row of the cloud, squared distance) of all pairs in neighbouring cells; x
        are points of the cloud."""
        own = self.codes(x)
        order = np.argsort(own, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if not len(group):
                continue
            at = own[group[0]]
            other = np.concatenate([self.order[lo:hi] for lo, hi in self._runs(at)])
            step = max(1, HELD_CELLS // len(other))
            for k in range(0, len(group), step):
                mine = group[k : k + step]
                for c in range(0, len(other), HELD_CELLS):
                    theirs = other[c : c + HELD_CELLS]
                    yield np.repeat(mine, len(theirs)), np.tile(theirs, len(mine)), distances(x[mine], self.cloud[theirs]).ravel()


def pairs_lsh(points: DataFrame, radius: float, closed: bool = True, tables: int = 8, seed: int = 42) -> DataFrame:
    """Approximate pairs by Spark's bucketed random projections: what shares a bucket of the
    radius' width in one of `tables` hashes. Every pair returned is right; some are missed. Only
    for radii far below the cloud's extent: beyond, nearly all pairs share a bucket."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    dim = dimension(points)
    vectors = points.select("point_id", "x", array_to_vector("x").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=max(radius, 1e-12), numHashTables=tables, seed=seed).fit(vectors)
    near = model.approxSimilarityJoin(vectors, vectors, radius * (1 + 1e-9) + 1e-12, "d")
    d2 = near.select(F.col("datasetA.point_id").alias("i"), F.col("datasetB.point_id").alias("j"), V.square_dist(F.col("datasetA.x"), F.col("datasetB.x"), dim).alias("d2"))
    return d2.where((F.col("d2") <= radius * radius) if closed else (F.col("d2") < radius * radius))


#: Named sources as other engines offer them: an index with a tolerance (here exact, which is
#: within any tolerance), a box tree (inclusive), and two graph-like approximate presets with
#: their recall.
PRESETS = {"approx": ("auto", None), "rtree": ("auto", True), "graph": ("pivots", 0.95), "fast_graph": ("pivots", 0.75)}


def radius_pairs(points: DataFrame, radius: float, closed: bool = False, provider: str | NeighborProvider = "auto", asked: DataFrame | None = None) -> DataFrame:
    """(i, j, d2): pairs closer than `radius` (or at it, if closed), a point with itself
    included; with `asked` (point_id) only those of the points asked, as i."""
    if callable(provider):
        return provider(points, radius, closed)
    if provider in PRESETS:
        provider, option = PRESETS[provider]
        if provider == "pivots":
            return pairs_pivots(points, radius, True, asked, option)
        closed = closed or bool(option)
    if provider == "auto":
        dim = dimension(points)
        provider = "blocks" if fits_broadcast(points, dim) or dim > GRID_AXES and not cells_prune(points, radius, dim) else "grid"
    if provider == "lsh":
        return pairs_lsh(points, radius, closed)
    if provider == "nested":
        return pairs_nested(points, radius, closed)
    return {"grid": pairs_grid, "blocks": pairs_blocks, "pivots": pairs_pivots}[provider](points, radius, closed, asked)


def nearest_on_line(values: np.ndarray, ids: np.ndarray, x: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the k nearest of sorted values, ties by the smaller
    id: the k-th distance lies within k positions, and all values within it are ranked."""
    at = int(np.searchsorted(values, x))
    lo, hi = max(0, at - k), min(len(values), at + k)
    near = np.abs(values[lo:hi] - x)
    radius = float(np.partition(near, k - 1)[k - 1])
    lo, hi = int(np.searchsorted(values, x - radius * (1 + 1e-12), "left")), int(np.searchsorted(values, x + radius * (1 + 1e-12), "right"))
    d = values[lo:hi] - x
    order = np.lexsort((ids[lo:hi], d * d))[:k]
    return lo + order, (d * d)[order]


def knn_line(points: DataFrame, k: int) -> DataFrame:
    """knn_blocks() for one axis: the broadcast cloud is sorted, so a point looks at few others."""
    ids, cloud = matrix_of(points)
    order = np.lexsort((ids, cloud[:, 0])) if len(ids) else np.arange(0)
    held = points.sparkSession.sparkContext.broadcast((ids[order], cloud[order, 0]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, values = held.value
        kk = min(k, len(ids))
        for frame in frames:
            found = [nearest_on_line(values, ids, x[0], kk) for x in frame["x"]]
            if not found:
                continue
            yield pd.DataFrame({
                "i": np.repeat(frame["point_id"].to_numpy(), kk), "j": ids[np.concatenate([p for p, _ in found])],
                "d2": np.concatenate([d for _, d in found]), "rank": np.tile(np.arange(1, kk + 1), len(found)),
            })

    return points.select("point_id", "x").mapInPandas(run, "i long, j long, d2 double, rank int")


def knn_blocks(points: DataFrame, k: int, block: int = 256) -> DataFrame:
    ids, cloud = matrix_of(points)
    held = points.sparkSession.sparkContext.broadcast((ids, cloud))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, cloud = held.value
        kk = min(k, len(ids))
        for frame in frames:
            for at in range(0, len(frame), block):
                part = frame.iloc[at : at + block]
                d2 = distances(np.array(part["x"].tolist(), dtype=np.float64), cloud)
                limit = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
                rows, cols = np.nonzero(d2 <= limit[:, None])  # ties at the limit, then the smaller ids
                order = np.lexsort((cols, d2[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
                keep = rank < kk
                rows, cols, rank = rows[keep], cols[keep], rank[keep]
                yield pd.DataFrame({"i": part["point_id"].to_numpy()[rows], "j": ids[cols], "d2": d2[rows, cols], "rank": rank + 1})

    return points.select("point_id", "x").mapInPandas(run, "i long, j long, d2 double, rank int")


def knn_expanding(points: DataFrame, k: int) -> DataFrame:
    """The same by radius joins: points that find under k neighbours ask again, twice as far."""
    from drumlin.operators.estimate import epsilon_estimation

    n, dim = points.count(), dimension(points)
    radius, todo, done = max(epsilon_estimation(points, 2 * k), 1e-12), points.select("point_id"), None
    w = Window.partitionBy("i").orderBy("d2", "j")
    least = min(k, n)
    while True:
        near = radius_pairs(points, radius, True, "grid", todo)
        # Written in each round, so no round computes the ones before it again. Ranks under k
        # are pruned before the sort (a window group limit), so a crowded cell sends few rows.
        ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ranked = written(ranked.withColumn("found", F.count("*").over(Window.partitionBy("i"))).select("i", "j", "d2", F.col("rank").cast("int").alias("rank"), "found"), "ranked")
        got = ranked.where(F.col("found") >= least).drop("found")
        done = got if done is None else done.union(got)
        todo = written(todo.join(got.select(F.col("i").alias("point_id")).distinct(), "point_id", "left_anti"), "todo")
        if todo.isEmpty():
            return done
        radius *= 2.0 if dim else 1.0


def knn_graph(points: DataFrame, k: int, provider: str = "auto") -> DataFrame:
    """(i, j, d2, rank): up to k nearest, the point itself first, ties by the smaller id."""
    if provider == "auto":
        dim, n = dimension(points), points.count()
        # A matrix of all pairs pays in high dimension, where cells prune little, and for few points.
        fits = n * dim * 8 <= BLOCK_BYTES and (dim == 1 or dim > GRID_AXES or n * n * dim <= ALL_PAIRS)
        provider = ("line" if dim == 1 else "blocks") if fits else "expanding"
    return {"line": knn_line, "blocks": knn_blocks, "expanding": knn_expanding}[provider](points, k)


def knn_core_dist(points: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """(point_id, core_dist): the distance to the k-th nearest, itself included; null if there
    are fewer points or it lies beyond the radius."""
    kth = knn_graph(points, k).where(F.col("rank") == k).select(F.col("i").alias("point_id"), F.col("d2"))
    out = points.select("point_id").join(kth, "point_id", "left")
    far = F.lit(False) if radius is None else F.col("d2") > radius * radius
    return out.select("point_id", F.when(~far, F.sqrt("d2")).alias("core_dist"))


def knn_core_dist_weighted(points: DataFrame, k: int) -> DataFrame:
    """As knn_core_dist(), where the weights of the up to k nearest first add up to k."""
    near = knn_graph(points, k).join(points.select(F.col("point_id").alias("j"), weight(points).alias("w")), "j")
    cum = F.sum("w").over(Window.partitionBy("i").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kth = near.withColumn("cum", cum).where(F.col("cum") >= k).groupBy(F.col("i").alias("point_id")).agg(F.sqrt(F.min("d2")).alias("core_dist"))
    return points.select("point_id").join(kth, "point_id", "left")


def core_distance(points: DataFrame, min_pts: int, radius: float) -> DataFrame:
    """(point_id, core_dist): weight-aware; the distance within the radius at which the
    neighbourhood's weight, itself included, reaches min_pts; null if it never does."""
    from drumlin.operators import prep
    from drumlin.operators.estimate import epsilon_estimation

    # Copies share one core distance, and most points find it within a much smaller radius.
    unique, mapping = (written(t, "copies") for t in prep.deduplicate(points))
    cloud = prep.as_weighted_cloud(unique)
    w = cloud.select(F.col("point_id").alias("j"), "w")
    cum = F.sum("w").over(Window.partitionBy("i").orderBy("d2", "j").rowsBetween(Window.unboundedPreceding, 0))
    reach, todo, done = min(radius, epsilon_estimation(cloud, 4 * min_pts) or radius), None, None
    while True:
        near = radius_pairs(cloud, reach, asked=todo).join(w, "j")
        got = near.withColumn("cum", cum).where(F.col("cum") >= min_pts).groupBy(F.col("i").alias("unique_id")).agg(F.sqrt(F.min("d2")).alias("core_dist"))
        got = written(got, "core")
        done = got if done is None else done.union(got)
        if reach >= radius:
            break
        todo = written(cloud.select("point_id").join(done.select(F.col("unique_id").alias("point_id")), "point_id", "left_anti"), "todo")
        if todo.isEmpty():
            break
        reach = min(radius, 2 * reach)
    return points.select("point_id").join(mapping.join(done, "unique_id").select("point_id", "core_dist"), "point_id", "left")


def avg_neighbors(points: DataFrame, radius: float, sample_cap: int = 64) -> float:
    """Mean neighbourhood size over an evenly spaced sample of at most `sample_cap` points."""
    n = points.count()
    if not n:
        return 0.0
    m = min(n, sample_cap)
    stride, dim = n // m, dimension(points)
    asked = points.where((F.col("point_id") % stride == 0) & (F.col("point_id") < stride * m)).select(F.col("point_id").alias("i"), F.col("x").alias("__a"))
    d2 = V.square_dist(F.col("__a"), F.col("x"), dim)
    near = points.join(F.broadcast(asked), d2 < radius * radius).count()
    return near / m
