"""Command line: cluster a CSV of coordinates, or the colours of an image.

    spark-submit drumlin/cli.py cluster_csv points.csv out --min-pts 10 --threshold 2.0
    spark-submit drumlin/cli.py color points.ppm out --algo hdbscan --space lab
    spark-submit drumlin/cli.py optics_color rgb.csv out --min-pts 20 --threshold 25
    spark-submit drumlin/cli.py color_study rgb.csv --algo optics-xi --xi 0.05"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from drumlin import api
from drumlin.operators import estimate, extract, palette, prep
from drumlin.plans import planner
from drumlin.sources import csv, images
from drumlin.store import written


def cluster_csv(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Writes <prefix>_points and <prefix>_reachability; Xi clusters where xi_chi > 0."""
    points = written(csv.read_points(spark, args.input), "points")
    reach = written(api.reachability(points, args.min_pts, args.epsilon), "reach")
    if args.xi_chi > 0:
        clusters = extract.range_points(reach, extract.xi_ranges(reach, args.xi_chi, args.min_pts))
    else:
        clusters = extract.flat_cut(reach, args.threshold)
    labels = prep.cluster_labels(points, clusters, prep.min_size_of(args.min_frac, points.count()))
    csv.export_points(points, f"{args.output}_points", labels)
    csv.export_reachability(reach, f"{args.output}_reachability")
    return estimate.summarize(labels).first().asDict()


def color(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Clusters a P6 pixmap's colours; writes <output>_palette and prints a line of metrics."""
    content = spark.read.format("binaryFile").load(args.input).first()["content"]
    pixels = written(images.pixel_frame(spark, images.parse_ppm(bytes(content)), max_dim=args.max_dim), "pixels")
    began = time.perf_counter()
    _, colours, noise = palette.cluster_image(pixels, algo=args.algo, space=args.space)
    rows = colours.orderBy(F.desc("size")).collect()
    colours.write.mode("overwrite").csv(f"{args.output}_palette", header=True)
    return {"clusters": len(rows), "noise_fraction": noise, "seconds": round(time.perf_counter() - began, 3), "palette": [[r.r, r.g, r.b] for r in rows]}


def _rgb_points(spark: SparkSession, path: str):
    """The first three columns of a CSV as a cloud of single-precision values."""
    return prep.convert_cloud(prep.convert_cloud(csv.read_points(spark, path, 3), "float"), "double")


def optics_color(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Flat clusters of the distinct colours of an RGB table; writes <output>_points and reports
    each cluster's size and mean colour."""
    points = written(_rgb_points(spark, args.input), "points")
    n = points.count()
    least = int(args.min_frac * n)
    labels = written(prep.cluster_labels(points, api.threshold_clusters(points, args.min_pts, args.threshold, args.epsilon), least), "labels")
    csv.export_points(points, f"{args.output}_points", labels)
    summary = estimate.cluster_summary(labels, points).orderBy("label").collect()
    return {
        "n": n, "min_size_px": least, "noise": next((r.size for r in summary if r.label < 0), 0),
        "clusters": [{"label": r.label, "px": r.size, "mean_rgb": [int(v) for v in r.centroid]} for r in summary if r.label >= 0],
    }


def color_study(spark: SparkSession, args: argparse.Namespace) -> dict:
    """One algorithm on a table of colours; one line of metrics, labels and ordering on request."""
    began = time.perf_counter()
    points = written(prep.quantize(_rgb_points(spark, args.input), args.voxel), "points")
    n, read = points.count(), time.perf_counter()
    cloud, mapping = planner.dedup_if_smaller(points)
    unique, merged = cloud.count(), time.perf_counter()
    least = max(1, int(args.min_cluster_frac * n))
    size = args.min_cluster_size or max(args.min_pts, 2)
    expand = lambda clusters: clusters if mapping is None else prep.expand_to_original(clusters, mapping).select(*clusters.columns)
    reach, projected = None, {"seed": args.seed, "metric": args.metric, "n_projections": args.n_projections}
    if args.algo in ("optics-threshold", "optics-xi"):
        reach = written(api.reachability(cloud, args.min_pts, args.eps), "reach")
    elif args.algo == "soptics":
        reach = written(api.soptics_reachability(cloud, args.min_pts, args.eps, **projected), "reach")
    if reach is None:
        found = api.hdbscan(cloud, size, args.min_samples, dedup=False) if args.algo == "hdbscan" else api.shdbscan(cloud, size, args.min_samples, args.eps, dedup=False, **projected)
        clusters = found.where("label >= 0").select(F.col("label").alias("cluster_id"), "point_id")
        clusters = written(clusters, "clusters")
    core = time.perf_counter()
    if args.algo == "optics-xi":
        weights = cloud.select("point_id", "w") if "w" in cloud.columns else None
        clusters = extract.range_points(reach, extract.xi_ranges(reach, args.xi, args.min_pts, weights=weights))
    elif reach is not None:
        clusters = extract.flat_cut(reach, estimate.default_threshold(reach) if args.threshold < 0 else args.threshold)
    labels = written(prep.cluster_labels(points, expand(clusters), least), "labels")
    done = time.perf_counter()
    if args.labels_out:
        csv.export_points(points, args.labels_out, labels)
    if args.reach_out and reach is not None:
        csv.export_reachability(reach, args.reach_out)
    ms = lambda a, b: round(1000 * (b - a), 3)
    found = estimate.summarize(labels).first()
    return {
        "algo": args.algo, "n": n, "unique": unique, "collapse": n / max(unique, 1), "voxel": args.voxel, "min_pts": args.min_pts, "min_cluster_size": size, "min_size_px": least, "n_clusters": found.n_clusters,
        "noise": found.n_noise, "t_read_ms": ms(began, read), "t_dedup_ms": ms(read, merged), "t_core_ms": ms(merged, core), "t_extract_ms": ms(core, done), "t_total_ms": ms(began, done),
    }


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cluster_csv")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--min-pts", type=int, default=10)
    c.add_argument("--epsilon", type=float, default=-1.0)
    c.add_argument("--threshold", type=float, default=2.0)
    c.add_argument("--min-frac", type=float, default=0.01)
    c.add_argument("--xi-chi", type=float, default=0.0)
    c.set_defaults(run=cluster_csv)
    i = sub.add_parser("color")
    i.add_argument("input")
    i.add_argument("output")
    i.add_argument("--algo", choices=palette.ALGORITHMS, default="hdbscan")
    i.add_argument("--space", choices=tuple(palette.VOXEL), default="lab")
    i.add_argument("--max-dim", type=int, default=256)
    i.set_defaults(run=color)
    o = sub.add_parser("optics_color")
    o.add_argument("input")
    o.add_argument("output")
    o.add_argument("--min-pts", type=int, default=20)
    o.add_argument("--epsilon", type=float, default=-1.0)
    o.add_argument("--threshold", type=float, default=25.0)
    o.add_argument("--min-frac", type=float, default=0.01)
    o.set_defaults(run=optics_color)
    s = sub.add_parser("color_study")
    s.add_argument("input")
    s.add_argument("--algo", choices=("optics-threshold", "optics-xi", "hdbscan", "shdbscan", "soptics"), required=True)
    for name, default in (("min-pts", 20), ("min-cluster-size", 0), ("min-samples", 0), ("n-projections", 1024), ("seed", 42)):
        s.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("eps", -1.0), ("threshold", -1.0), ("xi", 0.05), ("voxel", 0.0), ("min-cluster-frac", 0.003)):
        s.add_argument(f"--{name}", type=float, default=default)
    s.add_argument("--metric", choices=("l2", "l1", "cosine"), default="l2")
    s.add_argument("--labels-out", default="")
    s.add_argument("--reach-out", default="")
    s.set_defaults(run=color_study)
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("drumlin").getOrCreate()
    out = args.run(spark, args)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
