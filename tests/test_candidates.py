"""Spanning trees of the complete graph without the complete graph."""

import numpy as np

from drumlin.operators import boruvka, hierarchy
from drumlin.schema import cloud_from_rows


def test_candidate_edges_hold_a_least_tree(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        points = cloud_from_rows(spark, np.round(np.concatenate([rng.normal(0, 1, (40, 1)), rng.normal(9, 0.2, (20, 1)), [[4.5], [30.0]]]), 1))
        edges = hierarchy.spanning_candidates(points, 4)
        assert edges.count() <= 62 * 4
        want = hierarchy.mst_total_weight(hierarchy.dense_mst(points, 4)).first()
        for tree in (boruvka.boruvka(points, edges), hierarchy.sparse_graph_mst(edges, 62)):
            got = hierarchy.mst_total_weight(tree).first()
            assert got[0] == want[0] == 61 and abs(got[1] - want[1]) < 1e-9


def test_complete_graph_is_not_shuffled(spark):
    rng = np.random.default_rng(7)
    points = cloud_from_rows(spark, rng.normal(0, 1, (30, 2)))
    core = hierarchy.core_distances(points, 4)
    pairs = hierarchy.complete_mutual_reachability(points, core)
    want = {(r.u, r.v): r.weight for r in hierarchy.mutual_reachability(hierarchy.complete_graph(points), core).collect()}
    assert {(r.u, r.v): r.weight for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastNestedLoopJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the points only
    assert {(r.u, r.v) for r in hierarchy.spanning_candidates(points, 4).collect()} == set(want)
