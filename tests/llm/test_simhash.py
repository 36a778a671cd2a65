import random

import numpy as np
import pytest

from drumlin.llm import simhash
from drumlin.llm.components import connected_components


def brute_components(fps, radius=2, others=None, second=0):
    ids, parent = list(range(len(fps))), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in ids:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and (others is None or (others[i] ^ others[j]).bit_count() <= second):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def signed(x):
    return int(np.uint64(x).view(np.int64))


def reference_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "A b", "É é a b c", "x y z w\x0bq   r", "the same the same the same the same", "w " * 5000 + "end"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == reference_fingerprint(text)


def fingerprints():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    out = list(base)
    for b in base[:10]:
        x = b
        for _ in range(12):  # chains: each link is two bits, the ends are far apart
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            out.append(x)
    centre = rng.getrandbits(64)
    out += [centre] + [centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    return [0, 1, 7, 15, *out, *base[:5]]


@pytest.mark.parametrize("bucket_limit", [2000, 3])
def test_components_match_brute_force(spark, bucket_limit):
    fps = fingerprints()
    rows = [(i, signed(f), signed(f)) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long, fp2 long")
    parts = simhash.components_of(df, id_col="doc_id", bucket_limit=bucket_limit)
    got = {r.doc_id: r.component_id for r in df.withColumnRenamed("fp", "node").join(parts, "node").collect()}
    assert [got[i] for i in range(len(fps))] == brute_components(fps)


def test_documents(spark):
    rows = [(5, "a b c d", 1, "x"), (3, "A B c  D", 2, "y"), (9, None, 3, "z"), (8, "", 4, "z"), (None, "q r s t u v", 5, ""), (3, "A B c  D", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert [(d, c) for d, _, c in got] == [(-1, None), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert all(f == f"{reference_fingerprint(t):016x}" for (_, f, _), t in zip(got, ["q r s t u v", "a b c d", "a b c d", "a b c d", "", ""], strict=True))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp) for r in kept.collect()) == [(-1, 5), (3, 2), (8, 4)]


def test_ids_need_not_be_unique(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "one two three four five six")], "doc_id long, text string")
    assert sorted(r.text[:3] for r in simhash.drop_near_duplicates(docs).collect()) == ["one", "sev"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).collect() == []
    assert simhash.drop_near_duplicates(docs).collect() == []


def test_allocation_is_the_cheapest():
    cost = np.array([[0, 5, 9, 100], [0, 2, 30, 60], [0, 8, 9, 10]], dtype=float)
    best = min((cost[0, a + 1] + cost[1, b + 1] + cost[2, c + 1]) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0)
    total, chosen = simhash.allocate(cost, 0)
    assert total == best and sum(chosen) == 0


def test_a_long_chain_is_one_component(spark):
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    links = [*zip(ids, ids[1:]), (2000, 2001)]
    parts = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in parts.collect()} == {**dict.fromkeys(ids, 0), 2000: 2000, 2001: 2000}


def test_a_document_that_drifts_by_two_bits_a_version_is_one_component(spark):
    rng = random.Random(6)
    chain = [rng.getrandbits(64)]
    while len(chain) < 600:
        i, j = rng.sample(range(64), 2)
        x = chain[-1] ^ 1 << i ^ 1 << j
        if all((x ^ y).bit_count() > 2 for y in chain[:-1]):
            chain.append(x)
    df = spark.createDataFrame([(n, signed(f), signed(f)) for n, f in enumerate(chain)], "doc_id long, fp long, fp2 long")
    assert {r.component_id for r in simhash.components_of(df, id_col="doc_id").collect()} == {0}


@pytest.mark.parametrize("bucket_limit", [2000, 40])
@pytest.mark.parametrize("radius", [5, 10])
def test_wide_radius_matches_brute_force(spark, radius, bucket_limit):
    rng = random.Random(radius)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(60)]
    for a, b in pairs[:30]:
        for _ in range(8):
            flips = [sum(1 << i for i in rng.sample(range(64), rng.randrange(radius + 4))) for _ in range(2)]
            pairs.append((a ^ flips[0], b ^ flips[1]))
    rows = [(i, signed(a), signed(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "doc_id long, fp long, fp2 long")
    parts = simhash.components_of(df, id_col="doc_id", radius=radius, bucket_limit=bucket_limit, second=radius)
    got = {r.doc_id: r.component_id for r in df.withColumn("node", simhash.node_of("fp", "fp2")).join(parts, "node").collect()}
    assert [got[i] for i in range(len(pairs))] == brute_components([a for a, _ in pairs], radius, [b for _, b in pairs], radius)


def test_buckets_hold_what_differs_in_the_threshold():
    bits, rng = [1, 5, 9, 20, 33, 63], random.Random(2)
    for t in range(4):
        masks = [m & (1 << 64) - 1 for m in simhash.bucket_masks(bits, t)]
        for _ in range(200):
            x, y = rng.getrandbits(64), rng.getrandbits(64)
            differ = sum((x ^ y) >> b & 1 for b in bits)
            assert any(x & m == y & m for m in masks) == (differ <= t)


def test_clashing_columns(spark):
    names = ["__id", "__h1", "__h2", "__first", "h1", "h2", "id", "node", "fp", "fp2", "component", "component_id", "least", "__text_of_fp", "__text_hash", "__row", "__kept_id"]
    docs = spark.createDataFrame([(i, "one two three four five six seven", *range(len(names))) for i in (4, 4, 7)], ["doc_id", "text", *names])
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()] == [4]


def test_near_copies_go_and_strangers_stay(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(40)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, words in enumerate(base):
        copy = list(words)
        for at in rng.sample(range(300), 3):  # three words of 300: 15 of 296 shingles on either side
            copy[at] = "new"
        docs.append((100 + i, " ".join(copy)))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(range(40)) <= kept and len(kept) <= 44
