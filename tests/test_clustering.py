import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drumlin import api
from drumlin.operators import boruvka, estimate, hierarchy, metrics, neighbors, ordering, prep, project
from drumlin.plans import planner
from drumlin.schema import cloud_from_rows, dimension
from drumlin.sources import generators


def brute_order(x, w, min_pts, eps):
    n = len(x)
    d = np.sqrt(neighbors.distances(x, x))
    near = [np.flatnonzero(neighbors.distances(x[i : i + 1], x)[0] < eps * eps) for i in range(n)]

    def core(i):
        ds = sorted((d[i, j], j) for j in near[i])
        total = 0
        for v, j in ds:
            total += w[j]
            if total >= min_pts:
                return v
        return None

    reach, done, out = [-1.0] * n, set(), []

    def visit(p):
        done.add(p)
        out.append(p)
        c = core(p)
        if c is not None:
            for o in near[p]:
                v = max(c, d[p, o])
                if o not in done and (reach[o] < 0 or v < reach[o]):
                    reach[o] = v

    for i in range(n):
        if i in done:
            continue
        visit(i)
        while True:
            seeds = [(reach[j], j) for j in range(n) if j not in done and reach[j] >= 0]
            if not seeds:
                break
            visit(min(seeds)[1])
    return [(p, reach[p]) for p in out]


def cloud(spark, x, w=None):
    df = cloud_from_rows(spark, np.asarray(x).tolist())
    return df if w is None else df.join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(w)], "point_id long, w long"), "point_id")


def rows_of(reach):
    return [(r.point_index, r.reachability) for r in reach.orderBy("order_index").collect()]


def labels_array(df, n):
    out = [-2] * n
    for r in df.collect():
        out[r.point_id] = r.label
    return out


@pytest.mark.parametrize("dim, weighted", [(1, False), (2, True), (3, False), (6, True)])
def test_kernel_against_brute_force(dim, weighted):
    rng = np.random.default_rng(dim)
    x = np.round(rng.normal(size=(150, dim)) * 3) if dim < 3 else rng.normal(size=(150, dim))
    w = rng.integers(1, 4, 150) if weighted else np.ones(150, dtype=int)
    for eps in (0.8, 2.5, 50.0):
        assert ordering.order_cloud(x, w, 5, eps) == brute_order(x, w, 5, eps)


def test_modes_and_groups_agree(spark):
    x, _ = generators.gaussian_blobs([(0, 0), (40, 0), (20, 35)], 40, 1.5, 1)
    points = cloud(spark, x)
    want = brute_order(x, np.ones(len(x), dtype=int), 5, 15.0)
    assert rows_of(api.reachability(points, 5, 15.0)) == want
    for mode in (planner.NeighborMode.PRECOMPUTE, planner.NeighborMode.AUTO):
        assert rows_of(api.reachability(points, 5, 15.0, mode=mode)) == want
    both = points.withColumn("g", F.lit("a")).union(points.withColumn("g", F.lit("b")))
    got = ordering.reachability(both, 5, 15.0, ["g"])
    assert all(rows_of(got.where(F.col("g") == g)) == want for g in "ab")


def test_flat_golden(spark):
    x = [(100, 100), (102, 100), (101, 101), (-1, 0), (1, 0), (0, 1), (-100, -100), (-102, -100), (-101, -101)]
    for eps, cut in ((10.0, 10.0), (-1.0, 2.0)):
        got = api.threshold_clusters(cloud(spark, x), 2, cut, eps).toPandas()
        parts = sorted(sorted(g) for _, g in got.groupby("cluster_id")["point_id"])
        assert parts == [[0, 1, 2], [3, 4, 5], [6, 7, 8]] or eps < 0


def test_uniform_epsilon_goldens(spark):
    two = [(0, 0), (1, 0), (0, 1), (10, 0), (0, 10), (6, 6), (4, 4), (10, 10), (9, 10), (10, 9)]
    three = [(0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 1, 0), (5, 0, 0), (0, 5, 0), (0, 0, 5), (5, 5, 5)]
    assert abs(estimate.epsilon_estimation(cloud(spark, two), 3) - 3.0901936) < 1e-6
    assert abs(estimate.epsilon_estimation(cloud(spark, three), 3) - 2.2367506) < 1e-6
    assert estimate.epsilon_estimation(cloud(spark, [(1, 2)]), 3) == 0.0 and estimate.epsilon_estimation(cloud(spark, [(1, 2)] * 3), 3) == 1.0


def test_dedup_equals_full_run(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 2)) * 2)
    a = api.threshold_clusters(cloud(spark, x), 6, 1.2, 2.0, dedup=True).toPandas()
    b = api.threshold_clusters(cloud(spark, x), 6, 1.2, 2.0, dedup=False).toPandas()
    parts = lambda f: sorted(sorted(g) for _, g in f.groupby("cluster_id")["point_id"])
    assert set(a["point_id"]) == set(b["point_id"]) == set(range(200))
    same = {tuple(p) for p in parts(a)} & {tuple(p) for p in parts(b)}
    assert sum(map(len, same)) >= 0.8 * 200


def test_dedup_tables(spark):
    x = [[v] * 3 for v in (10, 10, 10, 20, 30, 30)]
    unique, mapping = prep.deduplicate(cloud(spark, x))
    assert [(r.unique_id, r.first_id, r.w) for r in unique.orderBy("unique_id").collect()] == [(0, 0, 3), (1, 3, 1), (2, 4, 2)]
    assert [r.unique_id for r in mapping.orderBy("point_id").collect()] == [0, 0, 0, 1, 2, 2]
    rays = [(1, 2, 3), (2, 4, 6), (10, 20, 30), (1, 0, 0), (5, 0, 0), (0, 1, 0)]
    assert prep.deduplicate_cosine(cloud(spark, rays), 1e-6)[0].count() == 3 and prep.deduplicate(cloud(spark, rays))[0].count() == 6
    assert prep.deduplicate(prep.quantize(cloud(spark, [[v] for v in range(4)]), 8))[0].count() == 1
    assert prep.deduplicate(cloud(spark, [(0.0, 1.0), (-0.0, 1.0)]))[0].count() == 1


def test_providers_agree(spark):
    rng = np.random.default_rng(4)
    for dim in (1, 2, 5):
        points = cloud(spark, np.round(rng.normal(size=(120, dim)) * 4) / 2)
        for closed in (False, True):
            got = [sorted(map(tuple, neighbors.radius_pairs(points, 1.0, closed, p).collect())) for p in ("nested", "grid", "blocks")]
            assert got[0] == got[1] == got[2]
        a, b = (sorted(map(tuple, neighbors.knn_graph(points, 6, p).collect())) for p in ("blocks", "expanding"))
        assert a == b and len(a) == 720


def test_nearest_on_a_line(spark):
    rng = np.random.default_rng(11)
    points = cloud(spark, np.round(rng.normal(size=(200, 1)) * 6) / 2)
    for k in (1, 7, 40, 500):
        a, b = (sorted(map(tuple, neighbors.knn_graph(points, k, p).collect())) for p in ("line", "blocks"))
        assert a == b


def test_weighted_core_distance(spark):
    x = [[0.0], [1.0], [2.0], [3.0]]
    first = lambda w, k: neighbors.knn_core_dist_weighted(cloud(spark, x, w), k).where("point_id = 0").first()["core_dist"]
    assert [first([1, 1, 1, 1], 3), first([2, 1, 1, 1], 3), first([5, 1, 1, 1], 3), first([1, 1, 1, 1], 5)] == [2.0, 1.0, 0.0, None]
    core = neighbors.core_distance(cloud(spark, x, [2, 1, 1, 1]), 3, 1.5).where("point_id = 0").first()["core_dist"]
    assert core == 1.0


def test_knee_and_threshold(spark):
    vals = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1.1, 1.2, 1.3, 9])], "point_id long, core_dist double")
    assert estimate.kneedle(vals) == 1.3
    assert estimate.kneedle(vals.limit(0)) == -1.0 and estimate.kneedle(vals.where("point_id < 2")) == 1.1
    reach = spark.createDataFrame([(i, i, float(i)) for i in range(10)] + [(10, 10, -1.0)], "order_index long, point_index long, reachability double")
    assert estimate.default_threshold(reach) == 9.0 and estimate.default_threshold(reach.limit(0)) == 0.0


def blobs(spark, extra=()):
    x, y = generators.gaussian_blobs([(0, 0), (100, 0), (50, 100)], 30, 1.5, 7)
    x = np.vstack([x, np.array(extra).reshape(-1, 2)])
    return x, cloud(spark, x), np.concatenate([y, np.full(len(extra), -1)])


def test_hdbscan_blobs(spark):
    x, points, y = blobs(spark, [(500, 500), (-500, 500), (500, -500)])
    for algo in (planner.MstAlgorithm.DENSE_PRIM, planner.MstAlgorithm.BORUVKA, planner.MstAlgorithm.KNN_GRAPH):
        got = api.hdbscan(points, 5, mst_algo=algo).orderBy("point_id").toPandas()
        # In a graph that falls apart far points hang on a cluster before the clusters meet.
        if algo is not planner.MstAlgorithm.KNN_GRAPH:
            assert (got["label"][-3:] == -1).all() and (got["probability"][-3:] == 0).all()
        assert sorted(set(got["label"][:-3])) == [0, 1, 2]
        for c in range(3):
            assert got["label"][y == c].nunique() == 1
    leaf = api.hdbscan(points, 5, method="leaf").toPandas()
    assert leaf["label"].max() >= 2


def test_hdbscan_single_and_errors(spark):
    x, _ = generators.gaussian_blobs([(0, 0)], 40, 1.0, 2)
    points = cloud(spark, x)
    assert set(labels_array(api.hdbscan(points, 40), 40)) == {-1}
    assert set(labels_array(api.hdbscan(points, 40, allow_single_cluster=True), 40)) == {0}
    assert set(labels_array(api.hdbscan(points, 41), 40)) == {-1}
    same = cloud(spark, [(1.0, 2.0)] * 8)
    assert set(labels_array(api.hdbscan(same, 3, allow_single_cluster=True), 8)) == {-1}
    for bad in (lambda: api.hdbscan(points, 1), lambda: api.hdbscan(points, 5, method="x"), lambda: api.reachability(points, 0), lambda: api.shdbscan(points, 5, metric="x"), lambda: dimension(cloud(spark, [(float("nan"), 1.0)]))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        api.reachability(points, 5, 10.0, mode=planner.NeighborMode.PRECOMPUTE, max_precompute_bytes=64)


def test_spanning_trees_have_one_weight(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 3)), 1)
    points = cloud(spark, x)
    core = hierarchy.core_of_rows(np.sqrt(neighbors.distances(x, x)), None, 4)
    want = sum(w for *_, w in hierarchy.prim(x, core))
    full = hierarchy.mutual_reachability(hierarchy.complete_graph(points), hierarchy.core_distances(points, 4))
    for tree in (hierarchy.dense_mst(points, 4), api.exact_mst(points, 4), boruvka.boruvka(points, full), hierarchy.sparse_graph_mst(full, 90)):
        n, total = hierarchy.mst_total_weight(tree).first()
        assert n == 89 and math.isclose(total, want, rel_tol=1e-9)


def test_groups_cluster_as_alone(spark):
    rng = np.random.default_rng(9)
    x = np.round(np.vstack([rng.normal(c, 1, (40, 2)) for c in ((0, 0), (30, 0))]) * 2) / 2
    points = cloud(spark, x)
    alone = labels_array(api.hdbscan(points, 6), 80)
    both = points.withColumn("g", F.lit("a")).union(points.withColumn("g", F.lit("b")))
    got = hierarchy.cluster_groups(both, ["g"], 6)
    assert all(labels_array(got.where(F.col("g") == g), 80) == alone for g in "ab")
    assert set(labels_array(hierarchy.cluster_groups(both.where("point_id < 3"), ["g"], 6).where("g = 'a'"), 3)) == {-1}


def test_sparse_tree_bridges():
    assert hierarchy.kruskal(4, [(2, 3, 5.0)]) == [(2, 3, 5.0), (0, 1, 11.0), (0, 2, 11.0)]
    assert hierarchy.kruskal(3, []) == [(0, 1, 2.0), (0, 2, 2.0)]


def test_unit_weights_and_tables(spark):
    x, points, _ = blobs(spark)
    tree = hierarchy.dense_mst(points, 5)
    edges = [tuple(r) for r in tree.collect()]
    plain = hierarchy.extract_labels(90, edges, 5)
    assert plain == hierarchy.extract_labels(90, edges, 5, weights=[1] * 90)
    falls = hierarchy.condense(90, hierarchy.linkage_of(90, edges, None), 5, None)
    table = hierarchy.condensed_table(points, tree, 5)
    assert table.count() == len(falls)
    mass = hierarchy.stabilities(falls, 90)
    assert {r.cluster: pytest.approx(r.stability) for r in hierarchy.stability_table(table).collect()} == mass
    assert sorted(r.cluster for r in hierarchy.leaf_clusters(table, 90).collect()) == hierarchy.select_leaf(falls, 90)


def test_transforms():
    assert project.fwht(np.array([1.0, 0, 0, 0])).tolist() == [1, 1, 1, 1] and project.fwht(np.ones(4)).tolist() == [4, 0, 0, 0]
    x = np.random.default_rng(1).normal(size=(3, 32))
    assert np.allclose(project.fwht(project.fwht(x)), 32 * x)
    assert [project.next_pow2(n) for n in (0, 1, 16, 17)] == [1, 1, 16, 32]


def test_projection_graph(spark):
    x, _ = generators.angular_blobs(200, 16, 4, 0.1, 3)
    points = cloud(spark, x)
    exact = {(r.i, r.j) for r in neighbors.radius_pairs(points, 0.6, True).collect()}
    for kind in ("gaussian", "structured"):
        got = [(r.i, r.j) for r in project.ceos_graph(points, 0.6, 10, 256, projection=kind).collect()]
        found = set(got)
        assert len(found) == len(got) and found <= exact and len(found) > 0.6 * len(exact)
        assert all((j, i) in found for i, j in found) and all((i, i) in found for i in range(200))


def test_projected_clusterers(spark):
    x, y = generators.angular_blobs(240, 16, 4, 0.08, 6)
    points, truth = cloud(spark, x), spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "point_id long, label long")
    s = api.shdbscan(points, 10, n_projections=256)
    assert metrics.agreement(truth, s)["ari"] > 0.85
    o = api.soptics(points, 10, threshold=0.55, n_projections=256)
    assert metrics.agreement(truth, o)["rand"] > 0.85
    again = api.shdbscan(points, 10, n_projections=256)
    assert labels_array(s, 240) == labels_array(again, 240)
    z, yz = generators.gaussian_blobs([(0, 0), (30, 0), (0, 30)], 60, 1.0, 4)
    for metric in ("l2", "l1"):
        got = api.shdbscan(cloud(spark, z), 10, metric=metric, n_projections=256)
        t = spark.createDataFrame([(i, int(v)) for i, v in enumerate(yz)], "point_id long, label long")
        assert metrics.agreement(t, got)["rand"] > 0.85


def test_metrics(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-1, 3, 200), rng.integers(0, 4, 200)
    b[:120] = a[:120]
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    agree = np.mean([(a[i] == a[j]) == (b[i] == b[j]) for i in range(200) for j in range(i)])
    assert metrics.rand_index(df).first()[0] == pytest.approx(agree)
    assert 0 < metrics.adjusted_rand_index(df).first()[0] < 1 and 0 < metrics.normalized_mutual_info(df).first()[0] < 1
    same = df.select("a", (F.col("a") + 7).alias("b"))
    assert metrics.adjusted_rand_index(same).first()[0] == metrics.rand_index(same).first()[0] == 1.0
    assert metrics.normalized_mutual_info(same).first()[0] == pytest.approx(1.0)


def test_filters(spark):
    labels = [0] * 3 + [1] * 9 + [2] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "point_id long, label long")
    clusters = df.select(F.col("label").alias("cluster_id"), "point_id")
    assert labels_array(prep.cluster_labels(df, clusters, 5), 15) == [-1] * 3 + [0] * 9 + [-1] * 3
    assert labels_array(prep.significance_filter(df, 0.0), 15) == [2] * 3 + [0] * 9 + [1] * 3
    nested = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1)], "cluster_id long, point_id long")
    assert labels_array(prep.cluster_labels(df.limit(4), nested), 4) == [0, 1, 0, -1]


def test_policies():
    A, C, M = planner.NeighborMode, planner.CoreDistMode, planner.MstAlgorithm
    assert planner.resolve_acquisition(3, 2000, 20_000) == (A.ON_DEMAND, C.KNN)
    assert planner.resolve_acquisition(16, 2000, 100) == (A.PRECOMPUTE, C.SCAN)
    assert planner.resolve_acquisition(16, 2000, 10**9) == (A.ON_DEMAND, C.SCAN)
    assert [planner.resolve_mst(999, 3), planner.resolve_mst(1000, 15), planner.resolve_mst(1000, 16), planner.resolve_mst(1000, 16, False)] == [M.DENSE_PRIM, M.BORUVKA, M.KNN_GRAPH, M.BORUVKA]


def test_alias_and_empty(spark):
    x, points, _ = blobs(spark)
    with pytest.warns(DeprecationWarning):
        assert api.cluster_dbscan(points, 5, 10.0).count() == 90
    empty = points.limit(0)
    assert api.reachability(empty, 5).count() == 0 and api.cluster_threshold(empty, 5).count() == 0 and api.hdbscan(empty, 5).count() == 0


def test_presets(spark):
    rng = np.random.default_rng(8)
    points = cloud(spark, rng.normal(size=(150, 3)))
    exact = {(r.i, r.j) for r in neighbors.radius_pairs(points, 0.7, True, "nested").collect()}
    assert {(r.i, r.j) for r in neighbors.radius_pairs(points, 0.7, provider="rtree").collect()} == exact
    for name, least in (("graph", 0.9), ("fast_graph", 0.6)):
        got = [(r.i, r.j) for r in neighbors.radius_pairs(points, 0.7, provider=name).collect()]
        assert len(got) == len(set(got)) and set(got) <= exact and len(got) >= least * len(exact)


def test_small_tables(spark):
    from drumlin.operators import extract
    from drumlin.plans import matrix

    points = cloud(spark, [(0.0,), (1.0,), (5.0,)])
    tree = spark.createDataFrame([(0, 1, 1.0), (1, 2, 4.0)], "u long, v long, weight double")
    assert [tuple(r) for r in hierarchy.linkage_table(points, tree).orderBy("node").collect()] == [(3, 0, 1, 1.0, 2), (4, 3, 2, 4.0, 3)]
    clusters = spark.createDataFrame([(0, 2), (5, 0)], "cluster_id long, point_id long")
    assert labels_array(extract.labels_from_clusters(points, clusters), 3) == [1, -1, 0]
    assert matrix.kmeans_baseline(points, 2).select("label").distinct().count() == 2
    reach = spark.createDataFrame([(0, 3, -1.0)], "order_index long, point_index long, reachability double")
    assert extract.to_string(reach).first().text == "{3,-1.0}"
    assert matrix.density_params(100_000) == {"min_pts": 70, "small": 200, "large": 1000} and len(matrix.study_configs(1000)) == 7 and matrix.density_params(100)["large"] == 40


def test_release(spark):
    from drumlin import store

    path = store.shared_root(spark).removeprefix("file://")
    store.written(spark.range(3), "x")
    import os

    assert os.path.isdir(path)
    store.release(spark)
    assert not os.path.exists(path)
