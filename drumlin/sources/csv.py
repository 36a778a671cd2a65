"""The CSV contracts: coordinates, labelled points, orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drumlin.schema import dimension


def read_points(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(point_id, x) from a CSV of coordinates, with or without a header.

    A first field that is no number makes a header; then as many columns count as have a
    name that begins with x, or all. Rows that are short or hold no numbers are skipped,
    further columns ignored. Ids follow the lines' order in the file."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "point_id long, x array<double>")
    fields = [f.strip() for f in first.value.split(",")]
    try:
        float(fields[0])
        header = False
    except ValueError:
        header = True
    named = sum(f.startswith("x") for f in fields) if header else 0
    dim = dim or named or len(fields)
    parts = lines.select(F.monotonically_increasing_id().alias("line"), F.split("value", ",").alias("f"))
    values = parts.select("line", F.transform(F.slice("f", 1, dim), lambda v: F.trim(v).try_cast("double")).alias("x"))
    good = values.where((F.size("x") == dim) & ~F.exists("x", lambda v: v.isNull()))
    from drumlin.schema import with_point_index

    return with_point_index(good.select("line", "x"), ["line"])


def pack(points: DataFrame, dim: int) -> DataFrame:
    """The first `dim` coordinates."""
    return points.withColumn("x", F.slice("x", 1, dim))


def points_table(points: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """x0.., cluster_id: a point without a label has -1."""
    dim = dimension(points)
    joined = points.withColumn("cluster_id", F.lit(-1).cast("long")) if labels is None else points.join(labels.select("point_id", F.col("label").cast("long").alias("cluster_id")), "point_id", "left")
    return joined.select("point_id", *(F.col("x")[k].alias(f"x{k}") for k in range(dim)), F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"))


def export_points(points: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    points_table(points, labels).sort("point_id").drop("point_id").write.mode("overwrite").csv(path, header=True)


def export_reachability(reach: DataFrame, path: str) -> None:
    reach.select("order_index", "point_index", "reachability").sort("order_index").write.mode("overwrite").csv(path, header=True)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    """What export_points() wrote: x0.., cluster_id."""
    return spark.read.csv(path, header=True, inferSchema=True)


def load_reachability(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="order_index long, point_index long, reachability double")


def export_truth(points: DataFrame, labels: DataFrame, path: str) -> None:
    """Coordinates, six significant digits, beside a row-aligned table of labels."""
    dim = dimension(points)
    shown = points.select("point_id", *(F.format_string("%.6g", F.col("x")[k]).alias(f"x{k}") for k in range(dim)))
    shown.sort("point_id").drop("point_id").write.mode("overwrite").csv(path, header=True)
    labels.sort("point_id").select("label").write.mode("overwrite").csv(f"{path}_truth", header=True)


def metrics_line(metrics: DataFrame) -> DataFrame:
    """One JSON line a row."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def tidy(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, measure, value): a row for each measure."""
    return rows.unpivot(keys, measures, "measure", "value")
