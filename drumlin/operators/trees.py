"""Trees as adjacency tables (node_id, parent_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_size(tree: DataFrame) -> int:
    return tree.count()


def roots(tree: DataFrame) -> DataFrame:
    return tree.where("parent_id is null")


def with_depth(tree: DataFrame) -> DataFrame:
    """Adds level, 0 at the roots, and path, the node ids from the root; one join a level."""
    keep = tree.drop("level", "path")
    level = roots(keep).withColumns({"level": F.lit(0), "path": F.array("node_id")})
    out = level
    while not level.isEmpty():
        above = level.select(F.col("node_id").alias("parent_id"), F.col("level").alias("__l"), F.col("path").alias("__p"))
        level = keep.join(above, "parent_id").withColumns({"level": F.col("__l") + 1, "path": F.concat("__p", F.array("node_id"))}).select(*out.columns)
        out = out.union(level)
    return out


def tree_depth(tree: DataFrame) -> int:
    """Levels of the deepest branch; 0 for an empty tree."""
    return (with_depth(tree).agg(F.max("level")).first()[0] or 0) + 1 if tree.count() else 0


def flatten_dfs(tree: DataFrame) -> DataFrame:
    """The nodes with a depth-first, parents-first position in `preorder`."""
    from pyspark.sql import Window

    return with_depth(tree).withColumn("preorder", F.row_number().over(Window.orderBy("path")) - 1)
