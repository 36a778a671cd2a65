"""Images as clouds of colours: clustering, palettes, recolouring, colour roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin import api
from drumlin.functions import color as C
from drumlin.operators import prep
from drumlin.store import written

# Default cell widths by space.
VOXEL = {"rgb": 4.0, "lab": 2.0}
ALGORITHMS = ("hdbscan", "shdbscan", "soptics", "threshold", "xi")


def lab_cloud(pixels: DataFrame) -> DataFrame:
    """(point_id, x) in Lab from pixels (point_id, r, g, b)."""
    return pixels.select("point_id", F.array(*C.srgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).alias("x"))


def rgb_cloud(pixels: DataFrame) -> DataFrame:
    return pixels.select("point_id", F.array(*(F.col(c).cast("double") for c in "rgb")).alias("x"))


def palette(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, fraction, r, g, b, l, a, lab_b): each cluster's mean colour."""
    n = labels.count()
    lab = C.srgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    joined = labels.where("label >= 0").join(pixels, "point_id").select("label", "r", "g", "b", lab[0].alias("lab_0"), lab[1].alias("lab_1"), lab[2].alias("lab_2"))
    return joined.groupBy("label").agg(
        F.count("*").alias("size"), (F.count("*") / F.lit(max(n, 1))).alias("fraction"), *(F.bround(F.avg(F.col(c).cast("double")), 0).cast("int").alias(c) for c in "rgb"),
        F.bround(F.avg("lab_0"), 1).alias("l"), F.bround(F.avg("lab_1"), 1).alias("a"), F.bround(F.avg("lab_2"), 1).alias("lab_b"),
    )


def recolor(labels: DataFrame, colours: DataFrame, background: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(point_id, r, g, b): every pixel in its cluster's mean colour, noise in the background.

    A palette has a row for each cluster, at most 1 / fraction of them after the filter."""
    shown = colours.select("label", "r", "g", "b")
    small = shown.count() <= 100_000
    joined = labels.join(F.broadcast(shown) if small else shown, "label", "left")
    return joined.select("point_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zip("rgb", background, strict=True)))


def cluster_image(
    pixels: DataFrame, *, algo: str = "hdbscan", space: str = "lab", voxel: float | str = "auto", min_cluster_size: int | None = None, min_pts: int | None = None, min_cluster_frac: float = 0.003, metric: str = "l2", seed: int = 42
) -> tuple[DataFrame, DataFrame, float]:
    """Labels (point_id, label), the palette and the share of noise of an image's pixels."""
    if algo not in ALGORITHMS:
        raise ValueError(f"algo must be one of {ALGORITHMS}")
    if space not in VOXEL:
        raise ValueError(f"space must be one of {tuple(VOXEL)}")
    n = pixels.count()
    cloud = lab_cloud(pixels) if space == "lab" else rgb_cloud(pixels)
    width = VOXEL[space] if voxel == "auto" else float(voxel)
    size = min_cluster_size or max(15, round(0.002 * n))
    near = min_pts or max(8, round(0.0007 * n))
    if algo == "hdbscan":
        labels = api.hdbscan(cloud, size, voxel=width).select("point_id", "label")
    elif algo == "shdbscan":
        labels = api.shdbscan(cloud, size, metric=metric, seed=seed, voxel=width).select("point_id", "label")
    elif algo == "soptics":
        labels = api.soptics(cloud, near, extract="xi", metric=metric, seed=seed, voxel=width)
    elif algo == "threshold":
        labels = api.cluster_threshold(cloud, near, voxel=width)
    else:
        labels = api.extract_xi(cloud, near, voxel=width)
    labels = written(prep.significance_filter(labels, min_cluster_frac), "labels")
    noise = labels.where("label < 0").count() / max(n, 1)
    return labels, palette(pixels, labels), noise


def colour_roles(colours: Sequence[Mapping], roles: Sequence[str]) -> tuple[float, dict[str, int]]:
    """The share of expected colour names that clusters (size, names) take, none without roles:
    the largest cluster first, of its names that are free the last of the roles; a cluster
    takes one."""
    taken: dict[str, int] = {}
    fits = [(c["size"], r, i) for i, c in enumerate(colours) for r, name in enumerate(roles) if name in c["names"]]
    for _, r, i in sorted(fits, reverse=True):
        if roles[r] not in taken and i not in taken.values():
            taken[roles[r]] = i
    return (len(taken) / len(roles) if roles else 0.0), taken


def match_across(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> list[tuple[int, int, float]]:
    """Greedy nearest pairs of two palettes' Lab colours, each colour once."""
    pairs = sorted((sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) ** 0.5, i, j) for i, p in enumerate(a) for j, q in enumerate(b))
    left, right, out = set(range(len(a))), set(range(len(b))), []
    for d, i, j in pairs:
        if i in left and j in right:
            left.remove(i)
            right.remove(j)
            out.append((i, j, d))
    return out


def cluster_info(labels: DataFrame, points: DataFrame) -> DataFrame:
    """(label, mean, centre, radius): each cluster's mean point and a sphere around it."""
    from drumlin.operators.estimate import cluster_summary

    means = cluster_summary(labels.where("label >= 0"), points).select("label", F.col("centroid").alias("mean"))
    return means.join(enclosing_sphere(labels, points), "label")


def enclosing_sphere(labels: DataFrame, points: DataFrame) -> DataFrame:
    """(label, centre, radius): a sphere around each cluster by Ritter's two passes.

    It is an aggregation in three joins, so a cluster is never gathered in one task."""
    from drumlin.functions import vectors as V
    from drumlin.schema import dimension

    dim = dimension(points)
    own = labels.where("label >= 0").join(points.select("point_id", "x"), "point_id").select("label", "point_id", "x")
    start = own.groupBy("label").agg(F.min(F.struct("point_id", "x")).alias("s")).select("label", F.col("s.x").alias("s"))
    far = lambda df, c: df.groupBy("label").agg(F.max(F.struct(V.square_dist(F.col("x"), F.col(c), dim).alias("d2"), "x")).alias("f"))
    one = far(own.join(start, "label"), "s").select("label", F.col("f.x").alias("p"))
    two = far(own.join(one, "label"), "p").select("label", F.col("f.x").alias("q"), (F.sqrt("f.d2") / 2).alias("half"))
    mid = one.join(two, "label").select("label", F.zip_with("p", "q", lambda u, v: (u + v) / 2).alias("centre"), "half")
    return own.join(mid, "label").groupBy("label").agg(F.first("centre").alias("centre"), F.greatest(F.max(V.dist(F.col("x"), F.col("centre"), dim)), F.max("half")).alias("radius"))
