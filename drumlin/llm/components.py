"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.llm.common import forget, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node.

    Each round every root hooks to its smallest neighbouring root if that is smaller, the
    hooks are followed to their ends, and the links are drawn between the new roots. A root
    that outlasts two rounds has a neighbour of its own that hooked to it, so two rounds
    halve the roots at least; rounds go on until no link is left, so labels are always
    final. A hub's links stand on the side of a join that Spark can split, and minima are
    pre-aggregated, so no task holds all links of a hub. Labels and links are written to the
    shared folder in each round; the plan never grows and a lost executor costs one round at
    most."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = materialize(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        up = follow(materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "hooks"))
        drawn = edges.join(renamed(up, "u", "cu"), "u").join(renamed(up, "v", "cv"), "v").where("cu <> cv")
        drawn = materialize(drawn.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "links")
        forget(edges)
        edges = drawn
        if labels is None:
            labels = up
            continue
        new = labels.join(renamed(up, "component", "above"), "component", "left").select("node", F.coalesce("above", "component").alias("component"))
        new = materialize(new, "labels")
        forget(labels)
        forget(up)
        labels = new
    forget(edges)
    return labels


def renamed(labels: DataFrame, node: str, component: str) -> DataFrame:
    return labels.select(F.col("node").alias(node), F.col("component").alias(component))


def follow(up: DataFrame) -> DataFrame:
    """Points every node to the end of its chain; each pass halves the chains."""
    while True:
        jumped = up.join(renamed(up, "component", "above"), "component").select("node", F.col("above").alias("component"), F.col("component").alias("was"))
        jumped = materialize(jumped, "hooks")
        forget(up)
        up = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return up
