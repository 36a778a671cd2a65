import random
import zlib

import pytest

from drumlin.llm import sharding


def brute_differencing(values, k):
    """Differencing with explicit sets, for one block."""
    parts = [(tuple([0] * (k - 1) + [v]), [[] for _ in range(k - 1)] + [[i]]) for i, v in enumerate(values)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[0][-1])
        (a, ga), (b, gb) = parts[0], parts[1]
        both = sorted(((x + y, g + h) for x, y, g, h in zip(a, b[::-1], ga, gb[::-1], strict=True)), key=lambda t: t[0])
        parts = [*parts[2:], (tuple(s for s, _ in both), [g for _, g in both])]
    return parts[0]


def test_differencing_matches_sets():
    rng = random.Random(3)
    for n, k in ((1, 3), (2, 3), (7, 2), (40, 4), (200, 8)):
        values = [rng.randrange(1, 10**9) for _ in range(n)]
        bins, sums = sharding.differencing([tuple([0] * (k - 1) + [v]) for v in values])
        got = [0] * k
        for v, b in zip(values, bins, strict=True):
            assert sorted(b) == list(range(k))
            got[b[-1]] += v
        assert got == sums == list(brute_differencing(values, k)[0])


def test_classic_case():
    bins, sums = sharding.differencing([(0, v) for v in (8, 7, 6, 5, 4)])
    assert sums == [14, 16]


def rows_of(spark, n=3000):
    rng = random.Random(1)
    texts = [None, "", "é" * 10] + ["x" * rng.randrange(1, 400) + str(i) for i in range(n)] + ["copy " * 30] * 100
    return texts, spark.createDataFrame([(i, t, i, "s") for i, t in enumerate(texts)], "doc_id long, text string, shard long, extra string")


@pytest.mark.parametrize("grain", [4096, 300])
def test_documents(spark, grain):
    texts, docs = rows_of(spark)
    out = sharding.shard_documents(docs, grain=grain, rows_per_bucket=300)
    assert out.columns == ["doc_id", "extra", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    totals, slots, groups = [0] * 8, [[] for _ in range(8)], {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        totals[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert groups.setdefault(raw, r.shard) == r.shard
    assert max(totals) - min(totals) <= 2
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_group_over_a_shard_share(spark):
    docs = spark.createDataFrame([(i, "y" * 50 if i < 400 else "z" * (i % 7) + str(i)) for i in range(1000)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, grain=200).collect()
    totals = {}
    for r in rows:
        totals[r.shard] = totals.get(r.shard, 0) + r.size
    big = {r.shard for r in rows if r.doc_id < 400}
    rest = [v for s, v in totals.items() if s not in big]
    assert len(big) == 1 and len(rest) == 7 and max(rest) - min(rest) <= 10


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, "c")], "doc_id long, text string")
    rows = sharding.shard_documents(docs, rows_per_bucket=2).collect()
    assert len(rows) == 5 and len({(r.shard, r.slot) for r in rows}) == 5


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
