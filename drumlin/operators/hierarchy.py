"""The hierarchy: spanning tree to linkage, condensed tree, selected clusters, labels.

All of it runs on a spanning tree of n - 1 edges in one task for each group; what grows
faster than n (distances, the tree itself) is elsewhere. Ties are fixed: edges go by
(weight, u, v)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.functions import vectors as V
from drumlin.operators.line import line_tree
from drumlin.operators.neighbors import distances, knn_core_dist, knn_core_dist_weighted, knn_graph, radius_pairs
from drumlin.schema import dimension, weight, with_point_index
from drumlin.store import written

METHODS = ("eom", "leaf")
CORE_CELLS = 2_000_000  # of the distances that are held at once


@dataclass(frozen=True, slots=True)
class Merge:
    """A node of the dendrogram: two nodes, the distance at which they merge, its weight."""

    left: int
    right: int
    dist: float
    size: int


@dataclass(frozen=True, slots=True)
class Fall:
    """An edge of the condensed tree: a point or a cluster leaves `parent` at `level`."""

    parent: int
    child: int
    level: float
    size: int


class Sets:
    """Disjoint sets whose representatives carry a current node."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


# Spanning trees


def core_distances(points: DataFrame, k: int) -> DataFrame:
    """(point_id, core): the distance to the k-th nearest, 0 where there is none."""
    found = knn_core_dist_weighted(points, k) if "w" in points.columns else knn_core_dist(points, k)
    return found.select("point_id", F.coalesce("core_dist", F.lit(0.0)).alias("core"))


def core_of_rows(d: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """Core distances from a full distance matrix: 0 where there are too few points."""
    n = len(d)
    if weights is None:
        return np.partition(d, k - 1, axis=1)[:, k - 1] if 0 < k <= n else np.zeros(n)
    out = np.zeros(n)
    for i in range(n):
        near = np.argsort(d[i], kind="stable")[:k]
        cum = np.cumsum(weights[near])
        if k > 0 and cum[-1] >= k:
            out[i] = d[i, near[int(np.searchsorted(cum, k))]]
    return out


def core_of_cloud(cloud: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """core_of_rows() over a block of rows at a time, so memory grows with n and not its square."""
    n = len(cloud)
    if weights is None and not 0 < k <= n:
        return np.zeros(n)
    block, out = max(1, CORE_CELLS // max(n, 1)), np.zeros(n)
    for at in range(0, n, block):
        d = np.sqrt(distances(cloud[at : at + block], cloud))
        if weights is None:
            out[at : at + block] = np.partition(d, k - 1, axis=1)[:, k - 1]
        else:
            out[at : at + block] = core_of_rows(d, weights, k)
    return out


def prim(cloud: np.ndarray, core: np.ndarray) -> list[tuple[int, int, float]]:
    """The mutual-reachability spanning tree of the whole graph, from point 0; O(n) memory."""
    n = len(cloud)
    best, source, open_ = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    edges, at = [], 0
    for _ in range(n - 1):
        open_[at] = False
        d = np.sqrt(distances(cloud[at : at + 1], cloud)[0])
        d = np.maximum(np.maximum(d, core), core[at])
        nearer = open_ & (d < best)
        best[nearer], source[nearer] = d[nearer], at
        nxt = int(np.where(open_, best, np.inf).argmin())
        edges.append((int(source[nxt]), nxt, float(best[nxt])))
        at = nxt
    return edges


def kruskal(n: int, edges: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The spanning tree of a sparse graph. Components that are left over hang on point 0 by
    edges longer than any of it: (2 * the longest, or 1) + 1."""
    sets, tree, longest = Sets(n), [], 0.0
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges):
        if sets.union(u, v):
            tree.append((u, v, w))
            longest = w
    bridge = (2 * longest if longest > 0 else 1.0) + 1.0
    tree += [(0, i, bridge) for i in range(1, n) if sets.union(0, i)]
    return tree


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    """(u, v, weight) from pairs (i, j, d2): the largest of the distance and both cores."""
    a, b = core.select(F.col("point_id").alias("i"), F.col("core").alias("ca")), core.select(F.col("point_id").alias("j"), F.col("core").alias("cb"))
    return edges.join(a, "i").join(b, "j").select(F.col("i").alias("u"), F.col("j").alias("v"), F.greatest("ca", "cb", F.sqrt("d2")).alias("weight"))


def _tree_in_one_task(edges: DataFrame, n: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        tree = kruskal(n, list(zip(frame["u"].tolist(), frame["v"].tolist(), frame["weight"].tolist(), strict=True)))
        yield pd.DataFrame(tree, columns=["u", "v", "weight"])

    return edges.select("u", "v", "weight").coalesce(1).mapInPandas(run, "u long, v long, weight double")


def forests(edges: DataFrame, parts: int = 0) -> DataFrame:
    """Drops edges that no spanning tree needs: each part of the edges keeps its own forest.

    Of any cycle inside a part the longest edge goes, so the whole's tree survives, and the
    last task gets at most parts * (n - 1) edges instead of all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([*frames, pd.DataFrame({"u": [], "v": [], "weight": []})], ignore_index=True)
        ids = {p: k for k, p in enumerate(pd.unique(pd.concat([frame["u"], frame["v"]])))}
        sets, keep = Sets(len(ids)), []
        ordered = frame.assign(a=frame[["u", "v"]].min(axis=1), b=frame[["u", "v"]].max(axis=1)).sort_values(["weight", "a", "b"])
        for u, v, w in zip(ordered["a"].tolist(), ordered["b"].tolist(), ordered["weight"].tolist(), strict=True):
            if sets.union(ids[u], ids[v]):
                keep.append((int(u), int(v), w))
        yield pd.DataFrame(keep, columns=["u", "v", "weight"]).astype({"u": "int64", "v": "int64", "weight": "float64"})

    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.select("u", "v", "weight").repartition(parts, "u", "v").mapInPandas(run, "u long, v long, weight double")


def sparse_graph_mst(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, weight) of the spanning tree of a graph over points 0..n-1, bridges included: in
    one task while the forests' edges are few, by rounds of joins beyond."""
    from drumlin.operators import boruvka

    left = written(forests(edges), "forests")
    if left.count() + n <= boruvka.LOCAL_EDGES:
        return _tree_in_one_task(left, n)
    points = edges.sparkSession.range(n).select(F.col("id").alias("point_id"))
    tree, parts = boruvka.forest_and_components(points, left)
    tree = written(tree, "tree")
    longest = tree.agg(F.max("weight")).first()[0] or 0.0
    roots = parts.groupBy("c").agg(F.min("p").alias("v")).where("v > 0")
    bridges = roots.select(F.lit(0).cast("long").alias("u"), "v", F.lit((2 * longest if longest > 0 else 1.0) + 1.0).alias("weight"))
    return tree.union(bridges)


def knn_graph_mst(points: DataFrame, min_samples: int, graph_k: int = 0) -> DataFrame:
    """The tree of the mutual-reachability graph of nearest neighbours; a core distance that
    the neighbours don't reach is the farthest of them."""
    n = points.count()
    k = min(n, graph_k or max(2 * min_samples, 10))
    near = knn_graph(points, k)
    core = approx_core_distances(near, points, min_samples)
    return sparse_graph_mst(mutual_reachability(near.where("i <> j"), core), n)


def approx_mutual_reachability_mst(points: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """(u, v, weight): the tree of a graph of candidate pairs (i, j, d2) over points 0..n-1,
    with core distances from the pairs too; what the pairs leave apart hangs on point 0."""
    pairs = written(pairs.select("i", "j", "d2"), "pairs")
    core = approx_core_distances(pairs, points, min_samples)
    return sparse_graph_mst(mutual_reachability(pairs.where("i < j"), core), points.count())


def approx_core_distances(pairs: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(point_id, core) from candidate pairs (i, j, d2): where the weight reaches k, else the
    farthest candidate, 0 without any."""
    from pyspark.sql import Window

    w = points.select(F.col("point_id").alias("j"), weight(points).alias("w"))
    cum = F.sum("w").over(Window.partitionBy("i").orderBy("d2", "j").rowsBetween(Window.unboundedPreceding, 0))
    got = pairs.join(w, "j").withColumn("cum", cum).groupBy("i").agg(F.coalesce(F.min(F.when(F.col("cum") >= k, F.col("d2"))), F.max("d2")).alias("d2"))
    return points.select("point_id").join(got.withColumnRenamed("i", "point_id"), "point_id", "left").select("point_id", F.coalesce(F.sqrt("d2"), F.lit(0.0)).alias("core"))


def prim_by_edge(cloud: np.ndarray, core: np.ndarray) -> list[tuple[int, int, float]]:
    """The tree that Kruskal gives with edges by (weight, smaller id, larger id): the lightest
    edge of that order that leaves the grown part comes next."""
    n = len(cloud)
    best, low, high, open_ = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    ids, edges, at = np.arange(n), [], 0
    for _ in range(n - 1):
        open_[at] = False
        d = np.maximum(np.maximum(np.sqrt(distances(cloud[at : at + 1], cloud)[0]), core), core[at])
        a, b = np.minimum(ids, at), np.maximum(ids, at)
        better = open_ & ((d < best) | ((d == best) & ((a < low) | ((a == low) & (b < high)))))
        best[better], low[better], high[better] = d[better], a[better], b[better]
        least = np.flatnonzero(open_ & (best == best[open_].min()))
        nxt = int(least[np.lexsort((high[least], low[least]))[0]])
        edges.append((int(low[nxt]), int(high[nxt]), float(best[nxt])))
        at = nxt
    return edges


#: Points up to which a tree of the complete graph is grown in one task; on one axis any number.
DENSE_POINTS = 100_000


def dense_mst(points: DataFrame, min_samples: int, by_edge: bool = False) -> DataFrame:
    """Prim over the complete graph: one task, O(n) memory, O(n^2) time, so clouds over
    DENSE_POINTS raise; clouds of one axis take n log n steps. Ties go by the point, or by
    the edge's ids."""
    if not by_edge and dimension(points) == 1:
        return _line_mst(points, min_samples)
    if points.count() > DENSE_POINTS:
        raise ValueError(f"over {DENSE_POINTS} points: a complete graph takes too long in one task, use another tree algorithm")
    grow = prim_by_edge if by_edge else prim
    core = core_distances(points, min_samples)
    joined = points.select("point_id", "x").join(core, "point_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True).sort_values("point_id")
        cloud = np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), -1)
        yield pd.DataFrame(grow(cloud, frame["core"].to_numpy()), columns=["u", "v", "weight"]).astype({"u": "int64", "v": "int64", "weight": "float64"})

    return joined.coalesce(1).mapInPandas(run, "u long, v long, weight double")


def _line_mst(points: DataFrame, min_samples: int) -> DataFrame:
    weighted = "w" in points.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True).sort_values("point_id")
        u, v, weights = line_tree(frame["x"].to_numpy(dtype=np.float64), frame["w"].to_numpy() if weighted else None, min_samples)
        yield pd.DataFrame({"u": u, "v": v, "weight": weights})

    slim = points.select("point_id", F.col("x")[0].cast("double").alias("x"), weight(points).alias("w"))
    return slim.coalesce(1).mapInPandas(run, "u long, v long, weight double")


def mst_total_weight(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight"))


# From the tree to labels


def linkage_of(n: int, tree: Sequence[tuple[int, int, float]], weights: Sequence[int] | None) -> list[Merge]:
    """The dendrogram: merge k makes node n + k."""
    sets, node, size, rows = Sets(n), list(range(n)), list(weights or [1] * n), []
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in tree):
        a, b = sets.find(u), sets.find(v)
        rows.append(Merge(node[a], node[b], w, size[a] + size[b]))
        sets.union(a, b)
        root = sets.find(a)
        node[root], size[root] = n + len(rows) - 1, rows[-1].size
    return rows


def condense(n: int, rows: Sequence[Merge], least: int, weights: Sequence[int] | None) -> list[Fall]:
    """Splits that leave `least` on both sides make clusters, n + 1 upwards and the left one
    first; what is smaller falls out of the cluster, point by point. The root is cluster n."""
    if n < 2:
        return []
    size_of = lambda node: rows[node - n].size if node >= n else (weights[node] if weights else 1)

    def points_below(node: int) -> Iterator[int]:
        level = [node]
        while level:
            below = []
            for x in level:
                if x < n:
                    yield x
                else:
                    below += [rows[x - n].left, rows[x - n].right]
            level = below

    out: list[Fall] = []
    fresh, level = n + 1, [(2 * n - 2, n)]
    while level:
        below = []
        for node, cluster in level:
            if node < n:
                continue
            merge = rows[node - n]
            at = 1.0 / merge.dist if merge.dist > 0 else math.inf
            sides = [(s, size_of(s)) for s in (merge.left, merge.right)]
            large = [s for s, c in sides if c >= least]
            if len(large) == 2:
                for side, count in sides:
                    out.append(Fall(cluster, fresh, at, count))
                    below.append((side, fresh))
                    fresh += 1
                continue
            for side, count in sides:
                if count >= least:
                    below.append((side, cluster))
                else:
                    out += [Fall(cluster, p, at, weights[p] if weights else 1) for p in points_below(side)]
        level = below
    return out


def stabilities(falls: Sequence[Fall], n: int) -> dict[int, float]:
    """For each cluster the sum of (level - its birth) * size; a NaN from infinite levels is 0."""
    birth = {f.child: f.level for f in falls if f.child >= n}
    out: dict[int, float] = {}
    for f in falls:
        gain = (f.level - birth.get(f.parent, 0.0)) * f.size
        out[f.parent] = out.get(f.parent, 0.0) + (0.0 if math.isnan(gain) else gain)
    return out


def children_of(falls: Sequence[Fall], n: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for f in falls:
        if f.child >= n:
            out.setdefault(f.parent, []).append(f.child)
    return out


def select_eom(falls: Sequence[Fall], n: int, allow_single: bool = False) -> list[int]:
    """Excess of mass: from the leaves up, children win only if strictly more stable together."""
    mass, children = stabilities(falls, n), children_of(falls, n)
    chosen: dict[int, list[int]] = {}
    for c in sorted(mass, reverse=True):
        kids = children.get(c, [])
        together = sum(mass.get(k, 0.0) for k in kids)
        if (c == n and not allow_single) or together > mass[c]:
            chosen[c] = [x for k in kids for x in chosen.get(k, [])]
            if together > mass[c]:
                mass[c] = together
        else:
            chosen[c] = [c]
    return sorted(chosen.get(n, []))


def select_leaf(falls: Sequence[Fall], n: int, allow_single: bool = False) -> list[int]:
    """The clusters without clusters below; the root only if it is one and allowed."""
    parents = {f.parent for f in falls}
    inner = {f.parent for f in falls if f.child >= n}
    return sorted(c for c in parents - inner if c != n or allow_single)


def labels_of(falls: Sequence[Fall], selected: Sequence[int], n: int) -> tuple[list[int], list[float]]:
    """Labels by ascending cluster id and membership: a point's level over the largest finite
    level among the points of its label; 1 where either is infinite or 0."""
    label_of = {c: k for k, c in enumerate(selected)}
    above = {f.child: f.parent for f in falls if f.child >= n}
    resolved: dict[int, int] = {}

    def resolve(c: int) -> int:
        path = []
        while c not in resolved and c not in label_of and c in above:
            path.append(c)
            c = above[c]
        got = resolved.get(c, label_of.get(c, -1))
        for p in path:
            resolved[p] = got
        return got

    labels, levels = [-1] * n, [0.0] * n
    for f in falls:
        if f.child < n:
            labels[f.child], levels[f.child] = resolve(f.parent), f.level
    most = [0.0] * len(selected)
    for label, level in zip(labels, levels, strict=True):
        if label >= 0 and math.isfinite(level):
            most[label] = max(most[label], level)
    probability = [0.0 if k < 0 else min(v, most[k]) / most[k] if most[k] > 0 and math.isfinite(v) else 1.0 for k, v in zip(labels, levels, strict=True)]
    return labels, probability


def extract_labels(n: int, tree: Sequence[tuple[int, int, float]], least: int, method: str = "eom", allow_single: bool = False, weights: Sequence[int] | None = None) -> tuple[list[int], list[float]]:
    """The tail that all spanning trees share."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if n < 2:
        return [-1] * n, [0.0] * n
    falls = condense(n, linkage_of(n, tree, weights), least, weights)
    selected = (select_eom if method == "eom" else select_leaf)(falls, n, allow_single)
    return labels_of(falls, selected, n)


def extract_from_mst(points: DataFrame, tree: DataFrame, min_cluster_size: int, method: str = "eom", allow_single: bool = False) -> DataFrame:
    """(point_id, label, probability) from a spanning tree (u, v, weight) over ids 0..n-1."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    weighted = "w" in points.columns
    rows = points.select(F.col("point_id").alias("u"), F.lit(-1).cast("long").alias("v"), weight(points).cast("double").alias("weight"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        own, edges = frame[frame["v"] < 0].sort_values("u"), frame[frame["v"] >= 0]
        weights = own["weight"].astype("int64").tolist() if weighted else None
        tree = list(zip(edges["u"].tolist(), edges["v"].tolist(), edges["weight"].tolist(), strict=True))
        labels, probability = extract_labels(len(own), tree, min_cluster_size, method, allow_single, weights)
        yield pd.DataFrame({"point_id": own["u"].to_numpy(), "label": labels, "probability": probability})

    return rows.union(tree.select("u", "v", "weight")).coalesce(1).mapInPandas(run, "point_id long, label long, probability double")


def linkage_table(points: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, left, right, dist, size): the dendrogram; nodes under n are points."""
    n = points.count()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        rows = linkage_of(n, list(zip(frame["u"].tolist(), frame["v"].tolist(), frame["weight"].tolist(), strict=True)), None)
        yield pd.DataFrame([(n + k, m.left, m.right, m.dist, m.size) for k, m in enumerate(rows)], columns=["node", "left", "right", "dist", "size"])

    return tree.select("u", "v", "weight").coalesce(1).mapInPandas(run, "node long, left long, right long, dist double, size long")


def condensed_table(points: DataFrame, tree: DataFrame, min_cluster_size: int) -> DataFrame:
    """(parent, child, lambda_val, child_size): the condensed tree as rows."""
    n = points.count()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames), ignore_index=True)
        edges = list(zip(frame["u"].tolist(), frame["v"].tolist(), frame["weight"].tolist(), strict=True))
        falls = condense(n, linkage_of(n, edges, None), min_cluster_size, None)
        yield pd.DataFrame([(f.parent, f.child, f.level, f.size) for f in falls], columns=["parent", "child", "lambda_val", "child_size"])

    return tree.select("u", "v", "weight").coalesce(1).mapInPandas(run, "parent long, child long, lambda_val double, child_size long")


def stability_table(condensed: DataFrame) -> DataFrame:
    """(cluster, stability) from the condensed table, as a self-join and a sum."""
    birth = condensed.select(F.col("child").alias("parent"), F.col("lambda_val").alias("birth"))
    gain = (F.col("lambda_val") - F.coalesce("birth", F.lit(0.0))) * F.col("child_size")
    return condensed.join(birth, "parent", "left").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.nanvl(gain, F.lit(0.0))).alias("stability"))


def leaf_clusters(condensed: DataFrame, n: int) -> DataFrame:
    """(cluster): clusters without clusters below, the root left out."""
    inner = condensed.where(F.col("child") >= n).select(F.col("parent").alias("cluster")).distinct()
    return condensed.select(F.col("parent").alias("cluster")).distinct().join(inner, "cluster", "left_anti").where(F.col("cluster") != n)


def complete_graph(points: DataFrame) -> DataFrame:
    """Pairs i < j of a small cloud, for checks: a theta join."""
    dim = dimension(points)
    a, b = points.select(F.col("point_id").alias("i"), F.col("x").alias("__a")), points.select(F.col("point_id").alias("j"), F.col("x").alias("__b"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", V.square_dist(F.col("__a"), F.col("__b"), dim).alias("d2"))


def spanning_candidates(points: DataFrame, min_samples: int) -> DataFrame:
    """(u, v, weight) by mutual reachability: edges that hold a spanning tree of the complete
    graph, so also one of its least weight.

    On one axis these are the pairs under min_samples places apart. Let c lie between a and b.
    Unless c's core distance is above the weight of a-b, a-c and c-b are no longer than a-b
    and replace it. If that holds of none between, each has fewer than min_samples points
    within that weight, and all from a to b are among them. In more axes it is the complete
    graph, its core distances joined before the pairs are made."""
    core = core_distances(points, min_samples)
    ends = points.select("point_id", "x").join(core, "point_id")
    if dimension(points) != 1:
        return complete_mutual_reachability(points, core)
    line = ends.select(F.col("x")[0].cast("double").alias("a"), "point_id", "core")
    ranged = with_point_index(line.select("a", F.col("point_id").alias("p"), F.struct("a", "point_id", "core").alias("x")), ["a", "p"])
    own = written(ranged.select(F.col("point_id").alias("pos"), "x"), "line")
    shifted = own.select(F.col("x").alias("s"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + max(1, min_samples))).alias("pos"))
    d = F.abs(F.col("x.a") - F.col("s.a"))
    u, v = F.col("s.point_id"), F.col("x.point_id")
    return shifted.join(own, "pos").select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.greatest("x.core", "s.core", d).alias("weight"))


def complete_mutual_reachability(points: DataFrame, core: DataFrame) -> DataFrame:
    """(u, v, weight) of all pairs u < v. The core distances go with the points, so the pairs
    stream from one join and none is shuffled."""
    dim = dimension(points)
    ends = written(points.select("point_id", "x").join(core, "point_id"), "ends")
    a, b = ends.select(F.col("point_id").alias("u"), F.col("x").alias("__a"), F.col("core").alias("ca")), ends.select(F.col("point_id").alias("v"), F.col("x").alias("__b"), F.col("core").alias("cb"))
    d = F.sqrt(V.square_dist(F.col("__a"), F.col("__b"), dim))
    # Both sides are dealt out, so the pairs come in pieces for all cores, whatever files hold the points.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(parts, "u").join(F.broadcast(b), F.col("u") < F.col("v")).select("u", "v", F.greatest("ca", "cb", d).alias("weight"))


def radius_graph(points: DataFrame, radius: float) -> DataFrame:
    return radius_pairs(points, radius).where("i < j")


def cluster_groups(points: DataFrame, group_cols: Sequence[str], min_cluster_size: int, min_samples: int = 0, method: str = "eom", allow_single: bool = False) -> DataFrame:
    """(groups, point_id, label, probability): each group's points clustered on their own, one
    task for each group; equal points of a group merge into weights first."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be 2 or more")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    groups = list(group_cols)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point_id")
        cloud = np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), -1) + 0.0
        out = frame[[*groups, "point_id"]].assign(label=-1, probability=0.0)
        if len(frame) < min_cluster_size:
            return out
        unique, first, inverse, counts = np.unique(cloud, axis=0, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first, kind="stable")  # distinct points in order of first sight
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        unique, counts, inverse = unique[order], counts[order], place[inverse.ravel()]
        weights = counts.tolist() if len(unique) < len(cloud) else None
        least, held = min_samples or min_cluster_size, counts if weights else None
        if unique.shape[1] == 1:
            tree = list(zip(*(a.tolist() for a in line_tree(unique[:, 0], held, least)), strict=True))
        else:
            tree = prim(unique, core_of_cloud(unique, held, least))
        labels, probability = extract_labels(len(unique), tree, min_cluster_size, method, allow_single, weights)
        return out.assign(label=np.array(labels)[inverse], probability=np.array(probability)[inverse])

    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "point_id long, label long, probability double"])
    return points.select(*groups, "point_id", "x").groupBy(*groups).applyInPandas(run, schema)
