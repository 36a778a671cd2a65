"""The public functions: clouds in, orderings and labels out."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import drumlin
from drumlin.operators import boruvka as B
from drumlin.operators import estimate as E
from drumlin.operators import extract as X
from drumlin.operators import hierarchy as H
from drumlin.operators import neighbors as N
from drumlin.operators import ordering as O
from drumlin.operators import prep as P
from drumlin.operators import project as R
from drumlin.plans import planner as L
from drumlin.schema import check_weights, dimension
from drumlin.store import written


def version() -> str:
    return drumlin.__version__


def quantize(points: DataFrame, bin_width: float) -> DataFrame:
    return P.quantize(points, bin_width)


def reachability(
    points: DataFrame, min_pts: int, epsilon: float = -1.0, *, mode: L.NeighborMode = L.NeighborMode.ON_DEMAND, core: L.CoreDistMode = L.CoreDistMode.SCAN, max_precompute_bytes: int = 0
) -> DataFrame:
    """(order_index, point_index, reachability). epsilon <= 0: the knee of the k-distances.

    `mode` and `core` choose how neighbours are fetched and never change the result:
    precompute joins the neighbour pairs in Spark and walks over them, on demand the walk
    asks a cell index."""
    if min_pts < 1:
        raise ValueError("min_pts must be 1 or more")
    dim = dimension(points)
    check_weights(points)
    if not dim:
        return O.reachability(points, min_pts, 1.0)
    if epsilon <= 0:
        points = written(points, "cloud")
        epsilon = E.epsilon_estimation_knee(points, min_pts)
    if mode is L.NeighborMode.AUTO:
        mode, core = L.resolve_acquisition(dim, N.avg_neighbors(points, epsilon), points.count(), max_precompute_bytes or L.CACHE_BUDGET)
    elif mode is L.NeighborMode.PRECOMPUTE:
        L.guard_precompute(points, epsilon, max_precompute_bytes)
    if mode is L.NeighborMode.PRECOMPUTE:
        return O.reachability_from_edges(points, N.radius_pairs(points, epsilon), min_pts)
    return O.reachability(points, min_pts, epsilon)


compute_reachability = reachability


def soptics_reachability(
    points: DataFrame, min_pts: int, epsilon: float = -1.0, *, n_projections: int = 1024, k: int = 0, m: int = 0, seed: int = 42, metric: str = "cosine", kernel_scale: float = 0.0, projection: str = "gaussian"
) -> DataFrame:
    """The ordering over the random-projection graph of unit vectors; epsilon <= 0: the
    uniform estimate on them."""
    if min_pts < 1:
        raise ValueError("min_pts must be 1 or more")
    unit = written(_unit_cloud(points, metric, kernel_scale, seed), "unit")
    if not dimension(unit):
        return O.reachability(unit, min_pts, 1.0)
    if epsilon <= 0:
        epsilon = E.epsilon_estimation(unit, min_pts)
    edges = R.ceos_graph(unit, epsilon, min_pts, n_projections, k, m, seed, projection)
    return O.reachability_from_edges(unit, edges, min_pts)


def _unit_cloud(points: DataFrame, metric: str, scale: float, seed: int) -> DataFrame:
    if metric not in R.METRICS:
        raise ValueError(f"metric must be one of {R.METRICS}")
    dimension(points)
    check_weights(points)
    if metric != "cosine":
        points = R.embed_features(points, metric, scale if scale > 0 else E.auto_kernel_scale(points, metric), seed)
    return P.normalize(points)


def _expand(clusters: DataFrame, mapping: DataFrame | None) -> DataFrame:
    return clusters if mapping is None else P.expand_to_original(clusters, mapping).select(*clusters.columns)


def threshold_clusters(points: DataFrame, min_pts: int, threshold: float = -1.0, epsilon: float = -1.0, *, dedup: bool = True) -> DataFrame:
    """(cluster_id, point_id) by a flat cut; threshold < 0: the 90 % rank of reachabilities."""
    cloud, mapping = L.dedup_if_smaller(points) if dedup else (points, None)
    reach = written(reachability(cloud, min_pts, epsilon), "reach")
    cut = E.default_threshold(reach) if threshold < 0 else threshold
    return _expand(X.flat_cut(reach, cut), mapping)


def xi_clusters(points: DataFrame, min_pts: int, chi: float = 0.05, epsilon: float = -1.0, *, min_diff: float = 0.0, min_cluster_size: int = 0, dedup: bool = True) -> DataFrame:
    """(cluster_id, point_id) by steep areas; clusters may nest."""
    cloud, mapping = L.dedup_if_smaller(points) if dedup else (points, None)
    reach = written(reachability(cloud, min_pts, epsilon), "reach")
    ranges = X.xi_ranges(reach, chi, min_pts, min_diff, min_cluster_size, cloud.select("point_id", "w") if "w" in cloud.columns else None)
    return _expand(X.range_points(reach, ranges), mapping)


def _labelled(points: DataFrame, clusters: DataFrame, fraction: float) -> DataFrame:
    return P.cluster_labels(points, clusters, P.min_size_of(fraction, points.count()))


def cluster_threshold(points: DataFrame, min_pts: int, threshold: float = -1.0, min_cluster_frac: float = 0.0, voxel: float = 0.0) -> DataFrame:
    """(point_id, label): quantise, cut, drop clusters under the fraction of all points."""
    return _labelled(points, threshold_clusters(P.quantize(points, voxel), min_pts, threshold), min_cluster_frac)


def cluster_dbscan(points: DataFrame, min_pts: int, threshold: float = -1.0, min_cluster_frac: float = 0.0, voxel: float = 0.0) -> DataFrame:
    warnings.warn("cluster_dbscan is the old name of cluster_threshold", DeprecationWarning, stacklevel=2)
    return cluster_threshold(points, min_pts, threshold, min_cluster_frac, voxel)


def extract_xi(points: DataFrame, min_pts: int, chi: float = 0.05, min_cluster_frac: float = 0.0, voxel: float = 0.0) -> DataFrame:
    return _labelled(points, xi_clusters(P.quantize(points, voxel), min_pts, chi), min_cluster_frac)


def _noise(points: DataFrame) -> DataFrame:
    return points.select("point_id", F.lit(-1).cast("long").alias("label"), F.lit(0.0).alias("probability"))


def _mst(points: DataFrame, min_samples: int, algorithm: L.MstAlgorithm, graph_k: int = 0) -> DataFrame:
    n, dim = points.count(), dimension(points)
    if algorithm is L.MstAlgorithm.AUTO:
        algorithm = L.resolve_mst(n, dim)
    if algorithm is L.MstAlgorithm.DENSE_PRIM:
        return written(H.dense_mst(points, min_samples), "tree")
    if algorithm is L.MstAlgorithm.KNN_GRAPH:
        return H.knn_graph_mst(points, min_samples, graph_k)
    return exact_mst(points, min_samples)


#: Points up to which one task is faster than rounds of joins; the tree is the same.
SMALL = 16_000


def exact_mst(points: DataFrame, min_samples: int) -> DataFrame:
    """The exact mutual-reachability tree from radius graphs of growing radius.

    An edge that a radius graph lacks is at least the radius long, so the forest of its edges
    below the radius belongs to the tree. The radius doubles until the forest spans. From
    the second round on only points outside the largest component ask, since one end of any
    edge still missing is among them, and what the forest has joined is not joined again. A
    cloud of up to SMALL points grows the same tree, ties included, in one task."""
    n = points.count()
    if n <= SMALL:
        return written(H.dense_mst(points, min_samples, by_edge=True), "tree")
    core = written(H.core_distances(points, min_samples), "core")
    # Copies at distance 0 with core 0 need a radius above 0; a typical core distance links most points.
    radius = core.agg(F.percentile_approx("core", 0.9)).first()[0] or E.epsilon_estimation(points, 2 * max(min_samples, 2)) or 1.0
    radius *= 1 + 1e-9
    forest, asked = None, None
    while True:
        pairs = N.radius_pairs(points, radius, asked=asked).where("i <> j")
        edges = H.mutual_reachability(pairs, core).where(F.col("weight") < radius)
        if forest is not None:
            edges = edges.union(forest)
        forest, part = B.forest_and_components(points, written(H.forests(edges), "near"))
        if forest.count() >= n - 1:
            return forest
        largest = part.groupBy("c").count().orderBy(F.desc("count"), "c").first()["c"]
        asked = written(part.where(F.col("c") != largest).select(F.col("p").alias("point_id")), "asked")
        radius *= 2


def hdbscan(
    points: DataFrame, min_cluster_size: int, min_samples: int = 0, method: str = "eom", allow_single_cluster: bool = False, *, dedup: bool = True, voxel: float = 0.0,
    mst_algo: L.MstAlgorithm = L.MstAlgorithm.AUTO,
) -> DataFrame:
    """(point_id, label, probability)."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be 2 or more")
    if method not in H.METHODS:
        raise ValueError(f"method must be one of {H.METHODS}")
    dimension(points)
    check_weights(points)
    points = written(P.quantize(points, voxel), "cloud")
    if points.count() < min_cluster_size:
        return _noise(points)
    cloud, mapping = L.dedup_if_smaller(points) if dedup and "w" not in points.columns else (points, None)
    if cloud.count() < 2:
        return _noise(points)
    tree = _mst(cloud, min_samples or min_cluster_size, mst_algo)
    return _expand(H.extract_from_mst(cloud, tree, min_cluster_size, method, allow_single_cluster), mapping)


def shdbscan(
    points: DataFrame, min_cluster_size: int, min_samples: int = 0, epsilon: float = -1.0, method: str = "eom", allow_single_cluster: bool = False, *, n_projections: int = 1024, k: int = 0, m: int = 0,
    seed: int = 42, metric: str = "cosine", kernel_scale: float = 0.0, projection: str = "gaussian", dedup: bool = True, voxel: float = 0.0,
) -> DataFrame:
    """hdbscan() over the random-projection graph; epsilon <= 0: 2, all of the unit sphere."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be 2 or more")
    points = written(P.quantize(points, voxel), "cloud")
    if points.count() < min_cluster_size:
        return _noise(points)
    cloud, mapping = L.dedup_if_smaller(points) if dedup and "w" not in points.columns else (points, None)
    if cloud.count() < 2:
        return _noise(points)
    least = min_samples or min_cluster_size
    unit = written(_unit_cloud(cloud, metric, kernel_scale, seed), "unit")
    edges = R.ceos_graph(unit, epsilon if epsilon > 0 else 2.0, least, n_projections, k, m, seed, projection)
    tree = H.approx_mutual_reachability_mst(unit, edges, least)
    return _expand(H.extract_from_mst(cloud, tree, min_cluster_size, method, allow_single_cluster), mapping)


def soptics(
    points: DataFrame, min_pts: int, extract: str = "threshold", threshold: float = -1.0, chi: float = 0.05, epsilon: float = -1.0, seed: int = 42, metric: str = "cosine", min_cluster_frac: float = 0.0, voxel: float = 0.0, **options
) -> DataFrame:
    """(point_id, label) from the random-projection ordering of the distinct points."""
    if extract not in ("threshold", "xi"):
        raise ValueError("extract must be threshold or xi")
    cloud, mapping = L.dedup_if_smaller(P.quantize(points, voxel))
    reach = written(soptics_reachability(cloud, min_pts, epsilon, seed=seed, metric=metric, **options), "reach")
    if extract == "threshold":
        clusters = X.flat_cut(reach, E.default_threshold(reach) if threshold < 0 else threshold)
    else:
        ranges = X.xi_ranges(reach, chi, min_pts, weights=cloud.select("point_id", "w") if "w" in cloud.columns else None)
        clusters = X.range_points(reach, ranges)
    return _labelled(points, _expand(clusters, mapping), min_cluster_frac)
