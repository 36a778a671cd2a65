"""Pairs of clouds with many copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drumlin import queries
from drumlin.operators import neighbors
from drumlin.schema import cloud_from_rows


@pytest.mark.parametrize("name", ["radius_pairs", "radius_pairs_approx", "radius_pairs_closed", "radius_pairs_rtree"])
def test_copies_of_parts_are_paired_by_spark(spark, tmp_path, name):
    """60 copies of 50 parts, their keys shifted as in a large table. Each pair came from Python
    as a row of its own; now lists of copies do, and Spark makes the pairs."""
    rng = np.random.default_rng(6)
    x = np.stack([rng.integers(1, 11, 50), np.round(rng.uniform(900, 920, 50), 2)], axis=1)
    x[0], x[1] = (1, 900), (7, 900)  # at the radius
    rows = [(k * 1000 + p, int(x[p, 0]), float(x[p, 1])) for k in range(60) for p in range(50)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    out = queries.QUERIES[name](spark, str(tmp_path))
    assert "Generate explode" in out._jdf.queryExecution().optimizedPlan().toString()
    d2 = neighbors.distances(x, x)
    near = d2 <= 36 if name in ("radius_pairs_closed", "radius_pairs_rtree") else d2 < 36
    got = out.selectExpr("i % 50 AS p", "j % 50 AS q", "i DIV 50 AS a", "j DIV 50 AS b", "d2").groupBy("p", "q", "d2").agg(F.count("*").alias("n"), F.countDistinct("a", "b").alias("pairs"))
    assert sorted(map(tuple, got.collect())) == [(p, q, np.floor(d2[p, q] * 1e6 + 0.5) / 1e6, 3600, 3600) for p, q in np.argwhere(near).tolist()]


def test_lists_of_copies_are_short():
    """12,000 copies at each of two places: 2.88 * 10^8 pairs of few entries and two distances."""
    places = neighbors.Places(np.arange(24_000), np.repeat([[0.0, 0.0], [9.0, 9.0]], 12_000, axis=0), 1.0, None, 4)
    batches = [b for t in range(4) for b in places.near(t, False)]
    assert sum(len(r["i"]) * len(r["j"]) for b in batches for r in b.to_pylist()) == 2 * 12_000**2
    assert sum(len(c.flatten()) for b in batches for c in b.columns) < 200_000


def test_places_give_every_pair_of_copies(monkeypatch):
    """In any cut into tasks, pieces of lists and choice of the points asked."""
    rng = np.random.default_rng(7)
    for dim, held in ((1, 7), (2, 7), (2, 100_000), (3, 7)):
        monkeypatch.setattr(neighbors, "SENT_PAIRS", held)
        cloud = np.round(rng.uniform(-3, 3, (150, dim)), int(dim == 1))
        cloud[:30] = cloud[0]
        ids = rng.permutation(1000)[:150]
        for asked in (None, ids[::3], np.array([5000])):
            for tasks in (1, 4, 300):
                for closed in (False, True):
                    places, got = neighbors.Places(ids, cloud, 1.0, asked, tasks), []
                    for row in (r for t in range(tasks) for b in places.near(t, closed) for r in b.to_pylist()):
                        assert 0 < len(row["i"]) <= held and 0 < len(row["j"]) <= held
                        got += [(i, j, d2) for i in row["i"] for j, d2 in zip(row["j"], row["d2"], strict=True)]
                    d2 = neighbors.distances(cloud, cloud)
                    near = np.argwhere(d2 <= 1 if closed else d2 < 1)
                    assert sorted(got) == sorted((int(ids[a]), int(ids[b]), d2[a, b]) for a, b in near if asked is None or ids[a] in asked)


def test_tasks_get_about_equal_work():
    """Half of 4,000 points are copies, which lie beside each other in the order of the tasks."""
    cloud = np.random.default_rng(8).uniform(0, 40, (4000, 2))
    cloud[:2000] = 7.0
    places = neighbors.Places(np.arange(4000), cloud, 1.0, None, 8)
    pairs = [sum(len(r["i"]) * len(r["j"]) for b in places.near(t, False) for r in b.to_pylist()) for t in range(8)]
    assert max(pairs) < 1.2 * np.mean(pairs)


def test_pairs_of_points_asked_with_copies(spark):
    points = cloud_from_rows(spark, [[0.0, 1.0], [0.0, 1.0], [-0.0, 1.0], [0.5, 1.0], [9.0, 9.0]])
    asked = spark.createDataFrame([(1,), (3,), (3,), (None,), (77,)], "point_id long")
    want = sorted(map(tuple, neighbors.radius_pairs(points, 1.0, False, "nested").where("i IN (1, 3)").collect()))
    assert sorted(map(tuple, neighbors.radius_pairs(points, 1.0, False, "blocks", asked).collect())) == want
    assert neighbors.radius_pairs(points, 1.0, False, "blocks", asked.where("point_id = 77")).count() == 0
