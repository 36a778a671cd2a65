"""Preparation: casts, quantisation, lossless deduplication, expansion, size filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drumlin.functions import vectors as V
from drumlin.schema import weight, with_point_index
from drumlin.store import written


def convert_cloud(points: DataFrame, dtype: str = "double") -> DataFrame:
    return points.withColumn("x", V.cast_cloud(F.col("x"), dtype))


def quantize(points: DataFrame, bin_width: float) -> DataFrame:
    return points.withColumn("x", V.quantize(F.col("x"), bin_width))


def normalize(points: DataFrame) -> DataFrame:
    return points.withColumn("x", V.normalize(F.col("x")))


def _collapse(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (point_id, x, key, w) the unique points, in order of first sight, and the map."""
    groups = keyed.groupBy("key").agg(F.min(F.struct("point_id", "x")).alias("first"), F.sum("w").alias("w"))
    groups = written(groups.select("key", F.col("first.point_id").alias("first_id"), F.col("first.x").alias("x"), "w"), "groups")
    index = with_point_index(groups.select("first_id", F.col("first_id").alias("x")), ["first_id"]).select(F.col("point_id").alias("unique_id"), F.col("x").alias("first_id"))
    unique = groups.join(index, "first_id")
    mapping = keyed.select("point_id", "key").join(unique.select("key", "unique_id"), "key").select("point_id", "unique_id")
    return unique.select("unique_id", "first_id", "x", "w"), mapping


def deduplicate(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique_id, first_id, x, w) and (point_id, unique_id).

    Equal points merge, +0.0 and -0.0 too; NaN is excluded by the cloud's contract."""
    key = F.transform("x", lambda v: v.cast("double") + F.lit(0.0))
    return _collapse(points.select("point_id", "x", key.alias("key"), weight(points).alias("w")))


def deduplicate_cosine(points: DataFrame, quantum: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """As deduplicate(), by direction: unit vectors, rounded to multiples of `quantum`. The
    representative is the first point itself; zero vectors collapse together."""
    unit = V.normalize(F.col("x"))
    if quantum > 0:
        q = float(quantum)
        unit = F.transform(unit, lambda v: F.signum(v) * F.floor(F.abs(v / q) + 0.5).cast("double") * q)
    key = F.transform(unit, lambda v: v + F.lit(0.0))
    return _collapse(points.select("point_id", "x", key.alias("key"), weight(points).alias("w")))


def as_weighted_cloud(unique: DataFrame) -> DataFrame:
    return unique.select(F.col("unique_id").alias("point_id"), "x", "w")


def expand_to_original(per_unique: DataFrame, mapping: DataFrame) -> DataFrame:
    """Columns of `per_unique` (point_id = unique id) for every original point."""
    u = per_unique.withColumnRenamed("point_id", "unique_id")
    return mapping.join(u, "unique_id").drop("unique_id")


def min_size_of(fraction: float, n: int) -> int:
    return max(1, int(fraction * n))


def cluster_labels(point_ids: DataFrame, clusters: DataFrame, min_cluster_size: int = 1) -> DataFrame:
    """(point_id, label): clusters (cluster_id, point_id) under the size become noise, -1; the
    others are numbered on in their order; where clusters overlap the later one wins."""
    sizes = clusters.groupBy("cluster_id").count().where(F.col("count") >= min_cluster_size).select("cluster_id")
    kept = with_point_index(sizes.select("cluster_id", F.col("cluster_id").alias("x")), ["cluster_id"]).select(F.col("x").alias("cluster_id"), F.col("point_id").alias("label"))
    found = clusters.join(kept, "cluster_id").groupBy("point_id").agg(F.max("label").alias("label"))
    return point_ids.select("point_id").join(found, "point_id", "left").select("point_id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def significance_filter(labels: DataFrame, fraction: float) -> DataFrame:
    """(point_id, label): clusters under max(1, int(fraction * n)) points become noise, the
    others are numbered by size downwards, the larger old id first in a tie."""
    least = min_size_of(fraction, labels.count())
    sizes = labels.where("label >= 0").groupBy("label").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    rank = sizes.select("label", (F.row_number().over(Window.orderBy(F.desc("cnt"), F.desc("label"))) - 1).cast("long").alias("new"))
    return labels.join(rank, "label", "left").select("point_id", F.coalesce("new", F.lit(-1)).cast("long").alias("label"))


def get_cluster_points(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(cluster_id, point_id, x) for clusters (cluster_id, point_id)."""
    return clusters.join(points.select("point_id", "x"), "point_id").select("cluster_id", "point_id", "x")
