import numpy as np
import pytest
from pyspark.sql import functions as F

from drumlin.llm import mixing


def corpus(spark, n=4000):
    rows = [(i, " ".join(["w"] * (1 + i % 13)) + (" a | b | c" if i % 5 == 0 else ""), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 7}", i) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "de", None, 0), (n + 1, "", "xx", "alone", 0)], "doc_id long, text string, lang string, source string, tokens long")


def plain_rake(cells, targets, budget, sweeps=300):
    fitted = {k: budget * t / sum(cells.values()) for k, t in cells.items()}
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            sums = {}
            for k, v in fitted.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            fitted = {k: v * (target[k[d]] * budget / sums[k[d]] if sums[k[d]] else 0) for k, v in fitted.items()}
        fitted = {k: min(v, cells[k]) for k, v in fitted.items()}
    return fitted


def test_marginals_meet_targets():
    rng = np.random.default_rng(0)
    tokens = rng.integers(50, 1000, 60).astype(float)
    codes = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    targets = [np.array([0.3, 0.25, 0.2, 0.15, 0.1]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2])]
    fitted = mixing.rake(tokens, codes, targets, budget=0.2 * tokens.sum())
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, fitted) / fitted.sum(), target, atol=1e-6)
    assert (fitted <= tokens).all()


def test_report(spark):
    docs = corpus(spark)
    rows = mixing.mixing_report(docs, fraction=0.5).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled"}
    cells = {}
    for r in rows:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    total = sum(cells.values())
    targets = []
    for d, a in enumerate((0.7, 0.8, 1.0)):
        sums = {}
        for k, v in cells.items():
            sums[k[d]] = sums.get(k[d], 0) + v
        raised = {k: (v / total) ** a if v else 0.0 for k, v in sums.items()}
        targets.append({k: v / sum(raised.values()) for k, v in raised.items()})
    want = plain_rake(cells, targets, 0.5 * total)
    for r in rows:
        k = (r.source, r.lang, r.topic)
        assert r.probability == pytest.approx(want[k] / cells[k] if cells[k] else 0, abs=1e-6)
    kept = sum(r.tokens for r in rows if r.sampled)
    assert abs(kept - 0.5 * total) < 0.05 * total
    assert {r.topic for r in rows} == {"prose", "tabular"}


def test_tables_rake_as_the_driver_does(spark):
    docs = corpus(spark, 600)
    a = {r.doc_id: r.probability for r in mixing.mixing_report(docs, fraction=0.5).collect()}
    b = {r.doc_id: r.probability for r in mixing.mixing_report(docs, fraction=0.5, cell_limit=2).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_explicit_targets_and_sample(spark):
    docs = corpus(spark)
    targets = {"source": {"hot": 1.0, "absent": 5.0}, "lang": 1.0, "topic": 1.0}
    kept = mixing.sample_to_targets(docs, targets=targets, fraction=0.3)
    assert kept.columns == docs.columns and {r.source for r in kept.select("source").distinct().collect()} == {"hot"}
    again = mixing.sample_to_targets(docs.repartition(5), targets=targets, fraction=0.3)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in again.collect())


def test_topic_column_and_empty(spark):
    docs = corpus(spark, 100)
    rows = mixing.mixing_report(docs, topic=F.col("lang")).collect()
    assert all(r.topic == r.lang for r in rows)
    assert mixing.mixing_report(docs.limit(0)).collect() == [] and mixing.sample_to_targets(docs.limit(0)).collect() == []
