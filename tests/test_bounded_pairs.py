"""Neighbour pairs and core distances whose memory and work don't grow with all pairs."""

import numpy as np

from drumlin.operators import estimate, neighbors
from drumlin.schema import cloud_from_rows


def test_a_piece_of_distances_is_bounded(monkeypatch):
    monkeypatch.setattr(neighbors, "HELD_CELLS", 50)
    rng = np.random.default_rng(1)
    for dim, scale in ((1, 1.0), (2, 1.0), (3, 1.0), (2, 1e14)):
        cloud = np.round(rng.uniform(-4, 4, (120, dim)), 1)
        cloud[:, -1] *= scale
        got, most = set(), 0
        for i, j, d2 in neighbors.CellRuns(cloud, 1.0).near(cloud):
            most = max(most, len(d2))
            got |= set(zip(i[d2 <= 1].tolist(), j[d2 <= 1].tolist(), strict=True))
        d2 = neighbors.distances(cloud, cloud)
        assert got == set(zip(*(a.tolist() for a in np.nonzero(d2 <= 1)), strict=True))
        assert most <= 120  # a point with the points of its cells, or HELD_CELLS


def test_pairs_in_many_axes_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = np.round(rng.normal(0, 1, (150, 12)), 1)
    points = cloud_from_rows(spark, [*rows, *rows[:20]])
    for closed in (False, True):
        a, b = (sorted(map(tuple, neighbors.radius_pairs(points, 3.0, closed, p).collect())) for p in ("nested", "blocks"))
        assert a == b


def test_core_distance_of_copies_takes_no_pairs_of_copies(spark):
    """30,000 copies at each of two places: 1.8 * 10^9 pairs, of which none is needed."""
    points = spark.range(60_000).selectExpr("id AS point_id", "array(CAST(id % 2 AS DOUBLE), 0.0D) AS x")
    assert neighbors.core_distance(points, 4, 6.0).where("core_dist = 0").count() == 60_000
    assert neighbors.core_distance(points, 30_001, 6.0).where("core_dist = 1").count() == 60_000
    assert neighbors.core_distance(points, 30_001, 1.0).where("core_dist IS NULL").count() == 60_000


def test_knee_of_copies_is_zero(spark):
    rows = cloud_from_rows(spark, [[0.0], [1.0], [2.0], [5.0]]).selectExpr("point_id", "x", "50L AS w")
    assert estimate.k_distance_knee(rows, 40) == 0.0
    assert estimate.epsilon_estimation_knee(rows, 40) > 0


def unit_vectors(n, dim=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_a_screen_misses_no_pair():
    rng = np.random.default_rng(4)
    for cloud, radius in ((unit_vectors(300), 1.3), (rng.normal(0, 1, (300, 5)) + 1e6, 1.0), (rng.normal(0, 1e-25, (200, 6)), 2e-25), (np.zeros((40, 4)), 0.0)):
        d2 = neighbors.distances(cloud, cloud)
        got = {(i, j) for a, b in neighbors.Screen(cloud, radius).near(cloud) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert got >= set(zip(*(a.tolist() for a in np.nonzero(d2 <= radius * radius)), strict=True))


def test_pivots_reach_their_recall_without_most_pairs():
    """Vectors of which few pairs are near, at the radius of radius_pairs_graph: Spark's hashing
    finds all, as every pair shares a bucket."""
    cloud = unit_vectors(6000)
    rng = np.random.default_rng(5)
    cloud[3000:] = cloud[rng.integers(0, 100, 3000)] + rng.normal(0, 0.12, (3000, 64))
    weights = np.where(np.arange(6000) < 100, 50.0, 1.0)
    d2 = np.concatenate([neighbors.distances(cloud[k : k + 500], cloud) for k in range(0, 6000, 500)])
    for recall in (0.75, 0.95):
        for w in (None, weights):
            pivots = neighbors.Pivots(cloud, 1.1, recall, w)
            filed = cloud[pivots.order]
            found, compared = np.zeros(d2.shape, dtype=bool), 0
            for i, j in pivots.near(neighbors.Screen(filed, 1.1), cloud):
                assert not found[i, pivots.order[j]].any()  # each pair once
                found[i, pivots.order[j]] = True
            near, ww = (d2 <= 1.21) & (d2 > 0), np.ones(6000) if w is None else w
            pairs = near * ww[:, None] * ww
            assert (pairs * found).sum() >= recall * pairs.sum()
            assert found[np.arange(6000), np.arange(6000)].all()
            assert pivots.looks < 0.9 * len(pivots.at)


def test_few_pairs_are_looked_for_everywhere():
    pivots = neighbors.Pivots(unit_vectors(400), 0.8, 0.75)
    assert pivots.looks == len(pivots.at)


def test_a_cloud_over_a_broadcast_is_searched_in_parts(spark, monkeypatch):
    """Three axes of unit vectors part nothing: beyond BLOCK_BYTES they went to the grid, which
    joins them all with all."""
    points = cloud_from_rows(spark, [*unit_vectors(220, 20), *unit_vectors(10, 20)])
    want = sorted(map(tuple, neighbors.radius_pairs(points, 1.1, True, "nested").collect()))
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 16_000)
    assert len(neighbors.parts_of(points, 20)) == 3
    for provider in ("auto", "graph"):  # with so few pairs, the index looks everywhere
        near = neighbors.radius_pairs(points, 1.1, True, provider)
        assert "BroadcastHashJoin" not in near._jdf.queryExecution().optimizedPlan().toString() and "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, near.collect())) == want
    asked = spark.createDataFrame([(5,), (221,)], "point_id long")
    for provider in ("auto", "graph"):
        assert sorted(map(tuple, neighbors.radius_pairs(points, 1.1, True, provider, asked).collect())) == [p for p in want if p[0] in (5, 221)]


def test_radius_pairs_graph_counts_copies_by_weight(spark, tmp_path):
    """20,000 copies of one vector: 4 * 10^8 pairs, none of which needs a row; and no vectors."""
    from drumlin import queries

    x = unit_vectors(50)
    rows = [(i, x[i if i < 50 else 7].tolist()) for i in range(20_050)]
    for n, d in ((20_050, "copies"), (0, "empty")):
        spark.createDataFrame(rows[:n], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / d / "embeddings.parquet"))
    near = neighbors.distances(x, x) <= 1.21
    w = np.where(np.arange(50) == 7, 20_001, 1)
    assert tuple(queries.radius_pairs_graph(spark, str(tmp_path / "copies")).first()) == ((near * w[:, None] * w).sum(), 0, True)
    assert tuple(queries.radius_pairs_graph(spark, str(tmp_path / "empty")).first()) == (0, 0, True)
