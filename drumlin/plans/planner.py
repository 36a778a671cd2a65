"""Choices that the library makes before Spark plans anything."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.operators import neighbors, prep
from drumlin.schema import check_weights, dimension
from drumlin.store import written

EDGE_BYTES = 16  # an id and a squared distance


class NeighborMode(Enum):
    AUTO = "auto"
    ON_DEMAND = "on_demand"
    PRECOMPUTE = "precompute"


class CoreDistMode(Enum):
    AUTO = "auto"
    SCAN = "scan"
    KNN = "knn"


class MstAlgorithm(Enum):
    AUTO = "auto"
    DENSE_PRIM = "dense_prim"
    BORUVKA = "boruvka"
    KNN_GRAPH = "knn_graph"


# The thresholds of the automatic choices.
DENSE_DIM, DENSE_NEIGHBORS = 8, 1000
PRIM_BELOW, BORUVKA_DIM = 1000, 16
CACHE_BUDGET = 1 << 30


def resolve_acquisition(dim: int, avg_neighbors: float, n: int, budget: int = CACHE_BUDGET) -> tuple[NeighborMode, CoreDistMode]:
    """How neighbours are fetched; it never changes the result."""
    if dim <= DENSE_DIM and avg_neighbors > DENSE_NEIGHBORS:
        return NeighborMode.ON_DEMAND, CoreDistMode.KNN
    fits = n * avg_neighbors * EDGE_BYTES <= budget
    return (NeighborMode.PRECOMPUTE if fits else NeighborMode.ON_DEMAND), CoreDistMode.SCAN


def resolve_mst(n: int, dim: int, knn_available: bool = True) -> MstAlgorithm:
    if n < PRIM_BELOW:
        return MstAlgorithm.DENSE_PRIM
    if dim < BORUVKA_DIM:
        return MstAlgorithm.BORUVKA
    return MstAlgorithm.KNN_GRAPH if knn_available else MstAlgorithm.BORUVKA


def guard_precompute(points: DataFrame, radius: float, max_bytes: int) -> None:
    """Raises where the estimated neighbour graph, ids and distances, exceeds max_bytes."""
    need = points.count() * neighbors.avg_neighbors(points, radius) * EDGE_BYTES
    if max_bytes and need > max_bytes:
        raise RuntimeError(f"the neighbour graph needs about {need:.3g} bytes, over {max_bytes}")


def dedup_if_smaller(points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The weighted cloud of distinct points and the map back; the cloud itself and None if
    nothing repeats."""
    dimension(points)
    check_weights(points)
    unique, mapping = (written(t, "dedup") for t in prep.deduplicate(points))
    if unique.count() == points.count():
        return points, None
    return prep.as_weighted_cloud(unique).select("point_id", "x", F.col("w").cast("long").alias("w")), mapping
