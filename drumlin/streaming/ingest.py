"""Streams of points: the distinct points and their weights, kept up to date.

This is the one stage of the engine that is
incremental by nature. Each micro-batch is summed to distinct points and appended as its own
partition keyed by batch id, so a batch that runs twice replaces itself; current() sums the
batches to the weighted cloud that every clusterer takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drumlin.schema import with_point_index


def distinct_sink(path: str):
    """A foreachBatch function for streams with a column x array<double>."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("x").agg(F.count("*").alias("w")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, x, w) over all batches so far, ids by coordinates."""
    seen = spark.read.parquet(path).groupBy("x").agg(F.sum("w").alias("w"))
    ids = with_point_index(seen.withColumn("__k", F.col("x")), ["__k"])
    return ids.join(seen, "x").select("point_id", "x", "w")
