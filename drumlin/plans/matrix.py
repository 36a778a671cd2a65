"""Benchmark tables: tidy result rows to summaries, gates and reports.

Rows are long: keys of a cell, engine, config, rep, a measure, its value, a status and a
time stamp. Reruns append; the latest row of a key counts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("cell_id", "engine", "config", "rep", "measure")


def latest(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each key the row with the latest time stamp."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("timestamp", *(c for c in rest if c != "timestamp"))).alias("r")).select(*keys, "r.*")


def medians(rows: DataFrame, by: Sequence[str] = ("cell_id", "engine", "config", "measure")) -> DataFrame:
    """The median over repetitions of the latest rows that ended well."""
    return latest(rows).where("status = 'ok'").groupBy(*by).agg(F.median("value").alias("value"))


def ratio_table(rows: DataFrame, measure: str, base: str, other: str, on: str = "engine") -> DataFrame:
    """(cell_id, base, other, ratio): how many times the base is of the other."""
    m = medians(rows).where(F.col("measure") == measure)
    wide = m.groupBy("cell_id").pivot(on, [base, other]).agg(F.first("value"))
    return wide.withColumn("ratio", F.col(f"`{base}`") / F.col(f"`{other}`"))


def pivot_report(rows: DataFrame, index: Sequence[str], columns: str, values: Sequence[str], statistic: str = "median") -> DataFrame:
    """A wide table of a statistic (median or avg) of the value."""
    agg = F.median("value") if statistic == "median" else F.avg("value")
    return rows.groupBy(*index).pivot(columns, list(values)).agg(agg)


def perf_gate(base: Mapping[str, float], head: Mapping[str, float], tolerance: float = 1.5) -> list[str]:
    """The names whose time grew by more than the tolerance; a name without a base passes."""
    return sorted(n for n, v in head.items() if n in base and base[n] > 0 and v / base[n] > tolerance)


def strip_status(rows: DataFrame, status: str) -> DataFrame:
    return rows.where(~F.col("status").eqNullSafe(status))


def run_cells(spark: SparkSession, cells: Iterable[Mapping], configs: Mapping[str, Callable], done: set[tuple] = frozenset(), reps: int = 1, gate: Callable[[Mapping, str], bool] | None = None) -> DataFrame:
    """Runs each config on each cell and returns tidy rows. `done` holds (cell, config, rep)
    to skip, `gate` says which are too dear to run."""
    rows = []
    for cell, (name, run), rep in product(list(cells), configs.items(), range(reps)):
        key = (cell["cell_id"], name, rep)
        if key in done:
            continue
        if gate and not gate(cell, name):
            rows.append((cell["cell_id"], "spark", name, rep, "time", None, "gated", time.time()))
            continue
        began = time.perf_counter()
        try:
            measures, status = dict(run(cell)), "ok"
        except (ValueError, RuntimeError) as e:
            measures, status = {}, f"failed: {e}"[:200]
        measures["time"] = time.perf_counter() - began
        rows += [(cell["cell_id"], "spark", name, rep, k, float(v), status, time.time()) for k, v in measures.items()]
    return spark.createDataFrame(rows, "cell_id string, engine string, config string, rep int, measure string, value double, status string, timestamp double")


# What in a file name tells a colour study's article, in order of precedence.
ARTICLES = [
    ("amlodipin_5mg", "amlodipin.*(5mg|_05)|(5mg|_05).*amlodipin"), ("amlodipin_10mg", "amlodipin.*(10mg|_10_)|(10mg|_10_).*amlodipin"),
    ("amlodipin_5mg", "amlodipin.*05|05.*amlodipin"), ("amlodipin_10mg", "amlodipin.*10|10.*amlodipin"),
    ("bild_koeln", "bild.*koeln|koeln.*bild"), ("spiegel_chatgpt", "chatgpt"), ("spiegel_hoffnung", "hoffnung"), ("spiegel_mutante", "mutante"),
]
# The colours that an article's image should show, and those of its surround,
# which a preprocessed image lacks.
ROLES = {
    "amlodipin_5mg": ["black", "white", "blue", "red"],
    "amlodipin_10mg": ["black", "white", "blue", "red"],
    "spiegel_chatgpt": ["black", "red", "orange", "white"],
    "spiegel_hoffnung": ["black", "red", "yellow", "white", "blue", "brown"],
    "spiegel_mutante": ["black", "red", "green", "white"],
    "bild_koeln": ["black", "white", "red", "yellow"],
}
SURROUND = {k: "black" for k in ROLES if k != "spiegel_mutante"}
# Which files of a study are which, and one export that is no image of it.
KINDS = {"original": "jpg", "preprocessed": "png"}
STRAY = "_prepped"


def article_of(name):
    """A column: the article that a file name tells; null if none."""
    out = F.lit(None).cast("string")
    for article, pattern in reversed(ARTICLES):
        known = F.lower(name).rlike(pattern)
        if not article.startswith("amlodipin"):
            known = known & ~F.lower(name).contains("amlodipin")
        out = F.when(known, article).otherwise(out)
    return out


def manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, article, kind) of the image files that belong to a study, from a column of paths."""
    name = F.regexp_extract(path, r"([^/]*)\.([^./]*)$", 1)
    ending = F.lower(F.regexp_extract(path, r"([^/]*)\.([^./]*)$", 2))
    kind = F.when(ending == KINDS["original"], "original").when((ending == KINDS["preprocessed"]) & (name != STRAY), "preprocessed")
    return files.select(F.col(path).alias("path"), article_of(name).alias("article"), kind.alias("kind")).where("article is not null and kind is not null")


def expected_roles(article: str, kind: str) -> list[str]:
    return [c for c in ROLES[article] if kind != "preprocessed" or SURROUND.get(article) != c]


def summarize_study(results: DataFrame, by: Sequence[str] = ("config", "space")) -> DataFrame:
    """Mean and median recall and time of a colour study, and its runs, by config and space."""
    return results.groupBy(*by).agg(F.count("*").alias("runs"), F.avg("recall").alias("mean_recall"), F.median("recall").alias("median_recall"), F.median("seconds").alias("median_seconds"))


def density_params(n: int) -> dict[str, int]:
    """Size-relative parameters of a colour study: neighbours, and a small and a large cluster."""
    return {"min_pts": max(8, round(0.0007 * n)), "small": max(15, round(0.002 * n)), "large": max(40, round(0.01 * n))}


def study_configs(n: int) -> dict[str, dict]:
    """The seven configurations of a colour study."""
    p = density_params(n)
    projected = {"metric": "l2", "seed": 42, "n_projections": 512}
    own = {
        "optics-thr": {"algo": "threshold", "min_pts": p["min_pts"], "threshold": -1.0}, "optics-xi05": {"algo": "xi", "min_pts": p["min_pts"], "chi": 0.05}, "optics-xi01": {"algo": "xi", "min_pts": p["min_pts"], "chi": 0.01},
        "hdbscan-sm": {"algo": "hdbscan", "min_cluster_size": p["small"]}, "hdbscan-lg": {"algo": "hdbscan", "min_cluster_size": p["large"]},
        "shdbscan": {"algo": "shdbscan", "min_cluster_size": p["small"]} | projected, "soptics": {"algo": "soptics", "min_pts": p["min_pts"], "threshold": -1.0} | projected,
    }
    return {name: flags | {"min_cluster_frac": 0.003} for name, flags in own.items()}


def kmeans_baseline(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(point_id, label) by Spark's own k-means, for comparison."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = points.select("point_id", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed).fit(vectors).transform(vectors).select("point_id", F.col("prediction").cast("long").alias("label"))
