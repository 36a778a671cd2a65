"""Scale estimates and aggregates over clouds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.operators.neighbors import distances, knn_core_dist, knn_core_dist_weighted, matrix_of
from drumlin.schema import dimension, weight
from drumlin.store import running_sum, written


def bounding_box(points: DataFrame) -> DataFrame:
    """(axis, low, high), one row for each axis."""
    axes = points.select(F.posexplode("x").alias("axis", "v"))
    return axes.groupBy("axis").agg(F.min(F.col("v").cast("double")).alias("low"), F.max(F.col("v").cast("double")).alias("high"))


def hypercuboid_volume(box: DataFrame) -> float:
    return math.prod(abs(r.high - r.low) for r in box.collect())


def unit_ball_volume(dim: int) -> float:
    return math.pi ** (dim / 2) / math.gamma(dim / 2 + 1)


def epsilon_estimation(points: DataFrame, min_pts: int) -> float:
    """The radius at which a uniform cloud of the same extent has min_pts neighbours; with
    weights, the number of points is their sum. Axes without extent don't count."""
    n = points.agg(F.coalesce(F.sum(weight(points)), F.lit(0))).first()[0]
    rows = points.count()
    if n <= 0:
        n = rows
    if rows <= 1:
        return 0.0
    extents = [r.high - r.low for r in bounding_box(points).orderBy("axis").collect() if r.high > r.low]
    if not extents:
        return 1.0
    d = len(extents)
    return (math.prod(extents) / n * min_pts / unit_ball_volume(d)) ** (1.0 / d)


def kneedle(k_distances: DataFrame) -> float:
    """The value at the knee of the ascending curve of `core_dist`: the first one farthest from
    the chord. Under three values: the one of the last point; none: -1; a flat curve: the last."""
    values = k_distances.where("core_dist is not null")
    n = values.count()
    if n == 0:
        return -1.0
    if n < 3:
        return values.orderBy(F.desc("point_id")).first()["core_dist"]
    low, high = values.agg(F.min("core_dist"), F.max("core_dist")).first()
    if high <= low:
        return high
    # Ranks come from counts of equal values, so a range partition suffices and ties share work.
    counts = values.groupBy("core_dist").agg(F.count("*").alias("c"))
    ranked = running_sum(counts, "core_dist", "c", "upto").withColumn("rank", F.col("upto") - F.col("c"))
    # Distance to the chord from (0, low) to (n - 1, high), without the constant factor; of a
    # tied value every rank counts and the first or the last one lies farthest.
    dx, dy = float(n - 1), high - low
    far = lambda rank: F.abs(dy * rank - dx * (F.col("core_dist") - low))
    both = ranked.withColumn("far", F.greatest(far(F.col("rank")), far(F.col("rank") + F.col("c") - 1)))
    return both.orderBy(F.desc("far"), F.asc("rank")).first()["core_dist"]


def epsilon_estimation_knee(points: DataFrame, min_pts: int) -> float:
    """The knee of the distances to the min_pts-th nearest, by weight where there are weights."""
    if min_pts < 1:
        raise ValueError("min_pts must be 1 or more")
    n = points.agg(F.coalesce(F.sum(weight(points)), F.lit(0))).first()[0]
    if n <= min_pts or points.count() <= 1:
        return epsilon_estimation(points, min_pts)
    knee = k_distance_knee(points, min_pts)
    return knee if knee > 0 else epsilon_estimation(points, min_pts)


def k_distance_knee(points: DataFrame, min_pts: int) -> float:
    """The knee itself, which is 0 where most points have min_pts copies; a radius needs
    epsilon_estimation_knee(), which then falls back to the uniform estimate."""
    found = knn_core_dist_weighted(points, min_pts) if "w" in points.columns else knn_core_dist(points, min_pts)
    return kneedle(written(found, "k-distances"))


def default_threshold(reach: DataFrame, quantile: float = 0.90) -> float:
    """The reachability at rank trunc(quantile * m) of the m defined ones; 0 if there is none."""
    finite = reach.where("reachability >= 0").groupBy("reachability").agg(F.count("*").alias("c"))
    m = finite.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if not m:
        return 0.0
    k = min(m - 1, int(quantile * m))
    upto = running_sum(finite, "reachability", "c", "upto")
    return upto.where(F.col("upto") > k).agg(F.min("reachability")).first()[0]


def auto_kernel_scale(points: DataFrame, metric: str = "l2", sample_cap: int = 48) -> float:
    """The upper median of pairwise distances over an evenly spaced sample; 1 if degenerate."""
    n = points.count()
    if n < 2:
        return 1.0
    stride = max(1, n // sample_cap)
    _, x = matrix_of(points.where(F.col("point_id") % stride == 0))
    if metric == "l1":
        d = [abs(x[i] - x[j]).sum() for i in range(len(x)) for j in range(i)]
    else:
        d2 = distances(x, x)
        d = [math.sqrt(d2[i, j]) for i in range(len(x)) for j in range(i)]
    d.sort()
    scale = float(d[len(d) // 2]) if d else 1.0
    return scale if scale > 0 else 1.0


def summarize(labels: DataFrame) -> DataFrame:
    """(n_clusters, n_noise)."""
    return labels.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.coalesce(F.sum((F.col("label") < 0).cast("long")), F.lit(0)).alias("n_noise"))


def cluster_summary(labels: DataFrame, points: DataFrame) -> DataFrame:
    """(label, size, centroid): count and mean of each cluster, noise (-1) included."""
    dim = dimension(points)
    joined = labels.join(points.select("point_id", "x"), "point_id")
    means = [F.avg(F.col("x")[k].cast("double")) for k in range(dim)]
    return joined.groupBy("label").agg(F.count("*").alias("size"), F.array(*means).alias("centroid"))


def principal_components(points: DataFrame, k: int = 2) -> DataFrame:
    """(point_id, pc0..): the first k principal components, for tables and plots of clouds of
    more than three dimensions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = points.select("point_id", array_to_vector("x").alias("v"))
    out = PCA(k=k, inputCol="v", outputCol="p").fit(vectors).transform(vectors).select("point_id", vector_to_array("p").alias("p"))
    return out.select("point_id", *(F.col("p")[i].alias(f"pc{i}") for i in range(k)))
