"""The point cloud: a DataFrame (point_id bigint, x array<double>[, w bigint])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drumlin.store import written


def cloud_from_columns(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], dtype: str = "double") -> DataFrame:
    """A cloud of `columns`, with point ids 0..n-1 by `order_by`, which must be unique."""
    return with_point_index(df.select(*order_by, F.array(*(F.col(c).cast(dtype) for c in columns)).alias("x")), order_by)


def with_point_index(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """(point_id, x): ids 0..n-1 in the given order.

    The rows are range-partitioned and each partition counts on from the ones before it, so
    no task sorts them all."""
    ranged = df.repartitionByRange(*order_by).withColumn("__part", F.spark_partition_id())
    local = ranged.select("__part", F.row_number().over(Window.partitionBy("__part").orderBy(*order_by)).alias("__rank"), "x")
    # Written once: a second evaluation could draw other range bounds.
    local = written(local, "ranked")
    counts = local.groupBy("__part").count()
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return local.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__rank") - 1).cast("long").alias("point_id"), "x")


def cloud_from_rows(spark: SparkSession, rows: Sequence[Sequence[float]]) -> DataFrame:
    """A small cloud from Python or NumPy rows; two-dimensional, ids in order."""
    data = [(i, [float(v) for v in r]) for i, r in enumerate(rows)]
    if len({len(r) for _, r in data}) > 1:
        raise ValueError("points must be a two-dimensional array")
    return spark.createDataFrame(data, "point_id long, x array<double>")


def dimension(points: DataFrame) -> int:
    """The one dimension of all points; raises on mixed dimensions, nulls, NaN or infinity."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    r = points.agg(F.min(F.size("x")), F.max(F.size("x")), F.max(F.col("x").isNull() | F.coalesce(bad, F.lit(True)))).first()
    if r[0] is None:
        return 0
    if r[0] != r[1] or r[0] < 1:
        raise ValueError("points must share one dimension of 1 or more")
    if r[2]:
        raise ValueError("points must not hold null, NaN or infinite coordinates")
    return r[0]


def check_weights(points: DataFrame) -> None:
    if "w" in points.columns and points.where(F.col("w").isNull() | (F.col("w") < 1)).limit(1).count():
        raise ValueError("weights must be 1 or more")


def weight(points: DataFrame) -> Column:
    return F.col("w") if "w" in points.columns else F.lit(1).cast("long")
