"""Tables in the folder that driver and executors share.

A result that several steps read is written once and read back: the plan stays short, and
unlike a cache the rows outlive any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of this application's tables under the shared folder; a temporary one only
    where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.drumlin.scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="drumlin-")
        spark.conf.set("spark.drumlin.scratch", path)
    return f"{path.rstrip('/')}/drumlin-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote there; results still to be computed
    from them are lost, so call it when they have been stored."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; only
    where that is unset, as in local tests, in a temporary folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    target = shared_path(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def running_sum(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` up to each row in the order of `by`, its own included; rows
    of equal `by` should be one row.

    Each range partition sums on from the ones before it, so no task sorts all rows."""
    ranged = df.repartitionByRange(by).withColumn("__part", F.spark_partition_id())
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    parts = written(ranged.withColumn("__own", own), "sums")  # a second evaluation could draw other range bounds
    before = parts.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = before.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")
