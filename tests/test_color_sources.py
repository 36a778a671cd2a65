import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from drumlin import cli
from drumlin.functions import color as C
from drumlin.operators import palette
from drumlin.plans import matrix
from drumlin.schema import cloud_from_rows
from drumlin.sources import csv, generators, images
from drumlin.streaming import ingest


def bands(seed=0):
    rng = np.random.default_rng(seed)
    base = np.repeat(np.array([(200, 35, 35), (35, 160, 70), (45, 65, 185)]), 40 * 30, axis=0)
    return np.clip(np.round(base + rng.normal(0, 4, base.shape)), 0, 255).astype(np.uint8).reshape(120, 30, 3)


def test_known_colours(spark):
    rows = [("white", 255, 255, 255), ("black", 0, 0, 0), ("red", 200, 30, 30), ("green", 30, 160, 60), ("blue", 40, 60, 190), ("gray", 128, 128, 128), ("yellow", 240, 220, 40)]
    df = spark.createDataFrame(rows, "name string, r int, g int, b int")
    lab = df.select("name", *(v.alias(n) for v, n in zip(C.srgb_to_lab(F.col("r"), F.col("g"), F.col("b")), ("l", "a", "bb"), strict=True)))
    got = {r.name: r for r in lab.withColumn("named", C.primary_color(F.col("l"), F.col("a"), F.col("bb"))).collect()}
    assert abs(got["white"].l - 100) < 0.01 and abs(got["white"].a) < 0.02 and got["black"].l == 0
    assert all(r.named == n for n, r in got.items())


def test_image_clusters(spark):
    pixels = images.pixel_frame(spark, bands())
    for space in ("lab", "rgb"):
        labels, colours, noise = palette.cluster_image(pixels, space=space)
        rows = colours.orderBy("label").collect()
        assert len(rows) == 3 and 0 <= noise < 1  # a cell that outweighs the least size is a cluster without points to lose, hence noise
        for want in ((200, 35, 35), (35, 160, 70), (45, 65, 185)):
            assert min(sum((a - b) ** 2 for a, b in zip(want, (r.r, r.g, r.b), strict=True)) ** 0.5 for r in rows) < 30
    shown = palette.recolor(labels, colours, (1, 2, 3))
    assert shown.count() == 3600
    ball = palette.enclosing_sphere(labels, palette.rgb_cloud(pixels)).collect()
    assert len(ball) == 3 and all(r.radius < 60 for r in ball)
    with pytest.raises(ValueError):
        palette.cluster_image(pixels, algo="x")


def test_roles_and_matching():
    recall, taken = palette.colour_roles([{"size": 5, "names": ["red"]}, {"size": 9, "names": ["red", "brown"]}], ["red", "brown", "blue"])
    assert recall == pytest.approx(2 / 3) and taken == {"brown": 1, "red": 0} and palette.colour_roles([], [])[0] == 0
    assert [(i, j) for i, j, _ in palette.match_across([(0, 0, 0), (9, 9, 9)], [(8, 8, 8), (1, 1, 1), (50, 0, 0)])] == [(0, 1), (1, 0)]


def test_images(spark, tmp_path):
    a = images.as_pixels(np.array([[[0.0, 0.5, 1.0]]]), bgr=True)
    assert a.tolist() == [[255, 127, 0]] and images.as_pixels(np.zeros((100, 50, 3), np.uint8), max_dim=10).shape == (50, 3)
    data = b"P6\n# note\n3 2\n255\n" + bytes([255] * 9 + [0, 0, 0] + [255] * 6)
    (tmp_path / "a.ppm").write_bytes(data)
    assert [r.x for r in images.read_ppm_points(spark, f"file://{tmp_path}/a.ppm").collect()] == [[0.0, 1.0]]
    with pytest.raises(ValueError):
        images.parse_ppm(b"P5 1 1 255 x")
    with pytest.raises(ValueError):
        images.cloud_from_array(spark, np.zeros(3))
    points = cloud_from_rows(spark, [(float(i),) for i in range(50)])
    some = images.sample_points(points, 10)
    assert some.count() == 10 and sorted(r.point_id for r in some.collect()) == list(range(10))


def test_image_files(spark, tmp_path):
    import struct
    import zlib

    px = bands()[:8, :6]
    raw = b"".join(b"\0" + row.tobytes() for row in px)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got = images.read_images(spark, f"file://{tmp_path}/a.png").orderBy("point_id").collect()
    assert [[r.r, r.g, r.b] for r in got] == px.reshape(-1, 3).astype(int).tolist()
    assert images.read_images(spark, f"file://{tmp_path}/a.png", max_dim=4).count() == 12


def test_components(spark):
    from drumlin.operators import estimate

    x = np.random.default_rng(0).normal(size=(60, 4)) * (9, 3, 1, 0.1)
    pc = estimate.principal_components(cloud_from_rows(spark, x.tolist())).toPandas()
    assert pc["pc0"].var() > pc["pc1"].var() > 4


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x0,x1,name\n1,2,a\n3\nx,4,b\n 5 ,6.5,c,more\n")
    got = csv.read_points(spark, f"file://{tmp_path}/p.csv")
    assert [(r.point_id, r.x) for r in got.orderBy("point_id").collect()] == [(0, [1.0, 2.0]), (1, [5.0, 6.5])]
    (tmp_path / "q.csv").write_text("1,2,3\n4,5,6\n")
    assert csv.read_points(spark, f"file://{tmp_path}/q.csv").count() == 2 and csv.pack(csv.read_points(spark, f"file://{tmp_path}/q.csv"), 2).first().x == [1.0, 2.0]
    csv.export_points(got, f"file://{tmp_path}/out", spark.createDataFrame([(1, 7)], "point_id long, label long"))
    back = csv.load_points(spark, f"file://{tmp_path}/out")
    assert back.columns == ["x0", "x1", "cluster_id"] and sorted(r.cluster_id for r in back.collect()) == [-1, 7]
    csv.export_truth(got, spark.createDataFrame([(0, 1), (1, 2)], "point_id long, label long"), f"file://{tmp_path}/t")
    assert spark.read.csv(f"file://{tmp_path}/t_truth", header=True).count() == 2
    line = csv.metrics_line(spark.createDataFrame([(1, 2.5)], "n int, s double")).first().value
    assert json.loads(line) == {"n": 1, "s": 2.5}
    assert csv.tidy(spark.createDataFrame([("a", 1.0, 2.0)], "k string, m double, n double"), ["k"], ["m", "n"]).count() == 2


def test_command_line(spark, tmp_path, capsys):
    x, _ = generators.gaussian_blobs([(0, 0), (40, 0)], 30, 1.0, 1)
    (tmp_path / "p.csv").write_text("x0,x1\n" + "\n".join(f"{a},{b}" for a, b in x))
    for extra in ([], ["--xi-chi", "0.1"]):
        out = cli.main(["cluster_csv", f"file://{tmp_path}/p.csv", f"file://{tmp_path}/o", "--min-pts", "5", "--threshold", "6", "--min-frac", "0.1", *extra])
        assert out["n_clusters"] >= 2
    assert csv.load_reachability(spark, f"file://{tmp_path}/o_reachability").count() == 60
    (tmp_path / "b.ppm").write_bytes(b"P6 30 120 255\n" + bands().tobytes())
    assert cli.main(["color", f"file://{tmp_path}/b.ppm", f"file://{tmp_path}/c"])["clusters"] == 3


def test_colour_commands(spark, tmp_path):
    rng = np.random.default_rng(2)
    rgb = np.vstack([rng.integers(0, 8, (150, 3)) + c for c in ((10, 10, 10), (200, 30, 30), (30, 60, 200))])
    path = f"file://{tmp_path}/rgb.csv"
    (tmp_path / "rgb.csv").write_text("r,g,b,name\n" + "\n".join(f"{r},{g},{b},x" for r, g, b in rgb))
    out = cli.main(["optics_color", path, f"file://{tmp_path}/o", "--min-pts", "8"])
    assert out["n"] == 450 and len(out["clusters"]) == 3 and sum(c["px"] for c in out["clusters"]) + out["noise"] == 450 and out["noise"] < 10
    for algo in ("optics-threshold", "optics-xi", "hdbscan"):
        got = cli.main(["color_study", path, "--algo", algo, "--min-pts", "8", "--threshold", "25", "--labels-out", f"file://{tmp_path}/{algo}_l", "--reach-out", f"file://{tmp_path}/{algo}_r"])
        assert got["algo"] == algo and got["n"] == 450 and got["unique"] <= 450 and got["min_size_px"] == 1 and got["n_clusters"] >= 3
        assert csv.read_points(spark, f"file://{tmp_path}/{algo}_l").count() == 450


def test_generators():
    for shape in generators.SHAPES:
        x, y = generators.generate(300, 5, 3, noise=0.1, shape=shape, seed=2)
        assert x.shape == (300, 5) and (y == -1).sum() == 30
        assert np.array_equal(x, generators.generate(300, 5, 3, noise=0.1, shape=shape, seed=2)[0])
    for name in ("blobs", "moons", "varied", "density"):
        assert generators.toy(name, 100)[0].shape == ((87 if name == "density" else 100), 2)
    for density in generators.DENSITIES:
        x, y = generators.blobs_nd(3000, 3, 4, density, noise=0.1)
        centres = np.array([x[y == i].mean(axis=0) for i in range(4)])
        nearest = min(np.linalg.norm(centres[i] - centres[j]) for i in range(4) for j in range(i))
        assert (y == -1).sum() == 300 and len(x) == 3000 and abs(nearest / generators.SEPARATION[density] - 1) < (0.6 if density == "mixed" else 0.15)
        assert generators.blobs_nd(100, 3, 4, density)[0].shape == (100, 3)
    assert np.allclose(np.linalg.norm(generators.angular_blobs(50, 8, 3)[0], axis=1), 1)
    assert generators.uniform_noise(5, (0, 0), (1, 1)).shape == (5, 2)


def test_matrix(spark):
    rows = [("c1", "a", "x", r, "time", v, s, t) for r, v, s, t in ((0, 9.0, "ok", 1.0), (0, 3.0, "ok", 2.0), (1, 5.0, "ok", 1.0), (2, 99.0, "failed", 1.0))] + [("c1", "b", "x", 0, "time", 2.0, "ok", 1.0)]
    df = spark.createDataFrame(rows, "cell_id string, engine string, config string, rep int, measure string, value double, status string, timestamp double")
    assert {(r.engine, r.value) for r in matrix.medians(df).collect()} == {("a", 4.0), ("b", 2.0)}
    assert matrix.ratio_table(df, "time", "a", "b").first().ratio == 2.0 and matrix.strip_status(df, "failed").count() == 4
    assert matrix.perf_gate({"q": 1.0, "r": 1.0}, {"q": 1.4, "r": 1.6, "new": 9.0}) == ["r"]
    got = matrix.run_cells(spark, [{"cell_id": "k"}], {"one": lambda c: {"n": 1}, "bad": lambda c: (_ for _ in ()).throw(ValueError("no")), "dear": lambda c: {}}, done={("k", "other", 0)}, gate=lambda c, n: n != "dear")
    assert {(r.config, r.measure, r.status[:6]) for r in got.collect()} == {("one", "n", "ok"), ("one", "time", "ok"), ("bad", "time", "failed"), ("dear", "time", "gated")}
    assert matrix.pivot_report(df, ["cell_id"], "engine", ["a", "b"]).count() == 1
    names = ["Amlodipin_5mg_01", "amlodipin_05_01", "amlodipin_10_02", "x_AMLODIPIN10mg", "amlodipin 05", "amlodipin 10", "amlodipin", "bild_x_koeln", "koeln", "chatgpt_spiegel", "hoffnung", "mutante2"]
    want = ["amlodipin_5mg"] * 2 + ["amlodipin_10mg"] * 2 + ["amlodipin_5mg", "amlodipin_10mg", None, "bild_koeln", None, "spiegel_chatgpt", "spiegel_hoffnung", "spiegel_mutante"]
    assert [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(matrix.article_of(F.col("n")).alias("k")).collect()] == want
    files = spark.createDataFrame([("/a/mutante.jpg",), ("/p/mutante_x.png",), ("/p/_prepped.png",), ("/a/other.jpg",), ("/a/hoffnung.txt",)], "path string")
    assert [(r.article, r.kind) for r in matrix.manifest(files).collect()] == [("spiegel_mutante", "original"), ("spiegel_mutante", "preprocessed")]
    assert matrix.expected_roles("bild_koeln", "preprocessed") == ["white", "red", "yellow"] and "black" in matrix.expected_roles("spiegel_mutante", "preprocessed")
    study = spark.createDataFrame([("a", "lab", 0.5, 1.0), ("a", "lab", 1.0, 3.0)], "config string, space string, recall double, seconds double")
    assert matrix.summarize_study(study).first().mean_recall == 0.75


def test_stream(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([([1.0, 2.0],), ([float(k), 0.0],)], "x array<double>").write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema("x array<double>").option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = stream.writeStream.foreachBatch(ingest.distinct_sink(f"file://{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.x, r.w) for r in ingest.current(spark, f"file://{tmp_path}/out").collect()) == [([0.0, 0.0], 1), ([1.0, 0.0], 1), ([1.0, 2.0], 2)]
