"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    A column that a lambda body names is evaluated anew for every element when the
    optimizer merges projections; binding it as a lambda variable rules that out."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of anything but space, tab, \\n, \\v, \\f and \\r; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and driver and executors are one process, as in local tests, a
    temporary folder takes its place; on a cluster it would be another folder on each machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.drumlin.scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="drumlin-")
        spark.conf.set("spark.drumlin.scratch", path)
    return f"{path.rstrip('/')}/drumlin-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet in the shared folder and reads it back.

    Unlike checkpoint() it runs the plan once, and unlike a cache or a local checkpoint
    the rows outlive any executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Removes a table that materialize() wrote and that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in folders:
        if path.startswith(shared_folder(df.sparkSession).replace("file://", "file:")) or "/drumlin-" in path:
            delete_folder(df.sparkSession, path)


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of few rows: Spark bounds the bytes of a batch, but Python objects made of a
    whole batch, and what is computed from them, would take several times as much."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
