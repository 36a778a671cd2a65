"""Agreement of two labellings, from their contingency table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.store import running_sum


def contingency(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, n): how many rows have each pair of labels; noise is a label like any other."""
    return pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def pair_counts(table: DataFrame) -> DataFrame:
    """One row: n, pairs, and pairs together in both, in a, in b."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / F.lit(2.0)
    zero = F.lit(0.0)
    cells = table.select(F.col("n").cast("double").alias("n"), two("n").alias("both"), zero.alias("in_a"), zero.alias("in_b"))
    rows = table.groupBy("a").agg(F.sum("n").alias("m")).select(zero, zero, two("m"), zero)
    cols = table.groupBy("b").agg(F.sum("n").alias("m")).select(zero, zero, zero, two("m"))
    sums = cells.union(rows).union(cols).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("n", "both", "in_a", "in_b")))
    return sums.withColumn("pairs", two("n"))


def rand_index(pairs: DataFrame) -> DataFrame:
    """(rand_index): the share of pairs on which both agree; 1 for fewer than two rows."""
    p = pair_counts(contingency(pairs))
    agree = F.col("pairs") + 2 * F.col("both") - F.col("in_a") - F.col("in_b")
    return p.select(F.when(F.col("pairs") > 0, agree / F.col("pairs")).otherwise(1.0).alias("rand_index"))


def adjusted_rand_index(pairs: DataFrame) -> DataFrame:
    """(ari); 1 where both labellings are degenerate."""
    p = pair_counts(contingency(pairs))
    expected = F.when(F.col("pairs") > 0, F.col("in_a") * F.col("in_b") / F.col("pairs")).otherwise(0.0)
    most = (F.col("in_a") + F.col("in_b")) / 2
    return p.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def normalized_mutual_info(pairs: DataFrame) -> DataFrame:
    """(nmi): mutual information over the mean of both entropies; 1 where both are 0."""
    t = contingency(pairs)
    total = float(t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1)
    rows, cols = t.groupBy("a").agg(F.sum("n").alias("ra")), t.groupBy("b").agg(F.sum("n").alias("cb"))
    cells = t.join(rows, t["a"].eqNullSafe(rows["a"])).drop(rows["a"]).join(cols, t["b"].eqNullSafe(cols["b"]))
    zero = F.lit(0.0)
    entropy = lambda c: -(F.col(c) / total * F.log(F.col(c) / total))
    parts = cells.select((F.col("n") / total * F.log(F.col("n") * total / (F.col("ra") * F.col("cb")))).alias("mi"), zero.alias("h"))
    parts = parts.union(rows.select(zero, entropy("ra"))).union(cols.select(zero, entropy("cb")))
    both = parts.agg(F.coalesce(F.sum("mi"), zero).alias("mi"), (F.coalesce(F.sum("h"), zero) / 2).alias("mean"))
    return both.select(F.when(F.col("mean") > 0, F.col("mi") / F.col("mean")).otherwise(1.0).alias("nmi"))


def agreement(a: DataFrame, b: DataFrame) -> dict[str, float]:
    """ari, nmi and rand of two tables (point_id, label)."""
    pairs = a.select("point_id", F.col("label").alias("a")).join(b.select("point_id", F.col("label").alias("b")), "point_id")
    return {"ari": adjusted_rand_index(pairs).first()[0], "nmi": normalized_mutual_info(pairs).first()[0], "rand": rand_index(pairs).first()[0]}


def average_ranks(values: DataFrame, column: str, name: str) -> DataFrame:
    """`values` with the average rank of `column` among all rows, from counts of equal values."""
    counts = running_sum(values.groupBy(column).agg(F.count("*").alias("__c")), column, "__c", "__upto")
    ranks = counts.select(F.col(column).alias("__v"), (F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / 2.0).alias(name))
    return values.join(ranks, F.col(column) == F.col("__v")).drop("__v")


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """(spearman): rank correlation of the reachabilities that both orderings define."""
    both = a.where("reachability >= 0").select("point_index", F.col("reachability").alias("ra")).join(b.where("reachability >= 0").select("point_index", F.col("reachability").alias("rb")), "point_index")
    ranked = average_ranks(average_ranks(both, "ra", "ka"), "rb", "kb")
    return ranked.agg(F.corr("ka", "kb").alias("spearman"))


def nan_to_none(value: float | None) -> float | None:
    return None if value is None or math.isnan(value) else value
