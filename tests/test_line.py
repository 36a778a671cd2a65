"""Kernels of one axis against the general ones, ties included, and the queries that rest on them."""

import numpy as np

from drumlin import api
from drumlin.operators import hierarchy, ordering
from drumlin.operators.line import line_order, line_tree
from drumlin.plans.planner import MstAlgorithm
from drumlin.schema import cloud_from_rows


def clouds(seed, trials=60):
    rng = np.random.default_rng(seed)
    for trial in range(trials):
        n = int(rng.integers(1, 90))
        x = (rng.integers(0, 30, n) / 100.0, np.round(rng.uniform(0, 5, n), 2), np.round(np.concatenate([rng.normal(0, 1, n // 2), rng.normal(20, 0.2, n - n // 2)]), 1))[trial % 3]
        yield rng, x.astype(float), int(rng.integers(1, 12))


def test_tree_is_prims_with_its_ties():
    for rng, x, k in clouds(1):
        for cloud, weights in ((x, None), (rng.permutation(np.unique(x)), rng.integers(1, 5, len(np.unique(x))))):
            core = hierarchy.core_of_rows(np.sqrt(hierarchy.distances(cloud[:, None], cloud[:, None])), weights, k)
            assert list(zip(*(a.tolist() for a in line_tree(cloud, weights, k)), strict=True)) == hierarchy.prim(cloud[:, None], core)


def test_core_distances_by_blocks_of_rows(monkeypatch):
    monkeypatch.setattr(hierarchy, "CORE_CELLS", 64)
    for rng, x, k in clouds(2):
        cloud = np.stack([x, rng.permutation(x)], axis=1)
        d = np.sqrt(hierarchy.distances(cloud, cloud))
        for weights in (None, rng.integers(1, 4, len(x))):
            assert (hierarchy.core_of_cloud(cloud, weights, k) == hierarchy.core_of_rows(d, weights, k)).all()


def test_groups_of_one_axis_need_no_matrix(spark):
    """40,000 distinct values in one group: their distance matrix would take 13 GB."""
    points = spark.range(40_000).selectExpr("id AS point_id", "id % 1 AS g", "array(((id * 7919) % 40000) * 1.0D + id % 3 * 0.25D) AS x")
    out = hierarchy.cluster_groups(points, ["g"], 5)
    assert out.count() == 40_000


def test_condensed_tree_and_stability_beyond_the_dense_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = cloud_from_rows(spark, np.round(rng.normal(0, 1, (40, 1)), 1))
    want = sorted(map(tuple, hierarchy.condensed_table(points, hierarchy.dense_mst(points, 4), 4).collect()))
    monkeypatch.setattr(hierarchy, "DENSE_POINTS", 10)
    rows = hierarchy.condensed_table(points, hierarchy.dense_mst(points, 4), 4)
    assert sorted(map(tuple, rows.collect())) == want
    assert hierarchy.stability_table(rows).count() >= 1


def test_hdbscan_beyond_the_dense_bound(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = cloud_from_rows(spark, np.round(rng.normal(0, 3, (200, 1)), 1))
    run = lambda method: sorted(map(tuple, api.hdbscan(points, 5, method=method, mst_algo=MstAlgorithm.DENSE_PRIM).collect()))
    want = [run("eom"), run("leaf")]
    monkeypatch.setattr(hierarchy, "DENSE_POINTS", 10)
    assert [run("eom"), run("leaf")] == want


def test_ordering_is_the_walk_with_its_ties():
    for rng, x, k in clouds(5):
        weights, eps = rng.integers(1, 4, len(x)), float(rng.choice([0.05, 0.3, 1.0, 10.0]))
        order, reach = line_order(x, weights, k, eps)
        assert list(zip(order.tolist(), reach.tolist(), strict=True)) == ordering.order_cloud(x[:, None], weights, k, eps)


def test_ordering_with_crowded_neighbourhoods(spark):
    """200,000 points of which each has all others within the radius: 4 * 10^10 pairs."""
    points = spark.range(200_000).selectExpr("id AS point_id", "array(((id * 7919) % 200000) * 0.001D) AS x")
    reach = api.reachability(points, 8, 1000.0)
    assert reach.where("reachability >= 0").count() == 199_999
