import random

import numpy as np
import pytest

from drumlin.llm import decontaminate as dc

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 7))) for _ in range(400)]


def prose(n, rng):
    return [VOCAB[min(int(rng.expovariate(0.02)), 399)] for _ in range(n)]


def edited(ws, k, rng):
    ws = list(ws)
    for _ in range(k):
        at = rng.randrange(len(ws))
        kind = rng.randrange(3)
        if kind == 0:
            ws[at] = "zzz" + str(rng.randrange(99))
        elif kind == 1:
            ws.insert(at, rng.choice(VOCAB))
        else:
            del ws[at]
    return ws


def brute_distance(item, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(doc, 1):
            new.append(min(row[j - 1] + (w != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng.randrange(12, 60), rng))) for i in range(30)]
    docs = []
    for d in range(150):
        ws = prose(rng.randrange(0, 300), rng)
        if d % 3 == 0:
            own = items[rng.randrange(30)][1].split()
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = edited(own, rng.randrange(int(len(own) * 0.3) + 1), rng)
        docs.append((d, " ".join(ws).capitalize() + ("." if d % 2 else "")))
    want = {(d, i): brute_distance(dc.words(t), dc.words(x)) for d, x in docs for i, t in items}
    want = {k: v for k, v in want.items() if v <= dc.allowed(len(items[k[1]][1].split()), 0.8)}
    return items, docs, want


def test_against_brute_force(case):
    items, docs, want = case
    index = dc.Index(items)
    got = {(docs[t][0], index.ids[i]): d for t, i, _, _, d in index.scan([x for _, x in docs])}
    assert set(got) <= set(want)
    assert all(got[k] >= want[k] for k in got)
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(got)
    assert len(got) >= 0.93 * len(want)
    assert min(c.recall for c in index.classes) >= 0.9


def test_distance_matches_brute_force():
    rng = random.Random(2)
    index = dc.Index([(0, " ".join(prose(25, rng)))])
    for _ in range(40):
        doc = prose(10, rng) + edited(words := list(index.vocabulary)[:1] + index_words(index), rng.randrange(6), rng) + prose(10, rng)
        del words
        stream = np.array([index.vocabulary.get(w, 0) for w in doc], dtype=np.int32)
        d, begin, end = index.distance(stream, 0, 10)
        whole = brute_distance(index_words(index), doc)
        assert d >= whole and (d == whole or whole > 4)
        assert brute_distance(index_words(index), doc[begin:end]) == d


def index_words(index):
    back = {v: k for k, v in index.vocabulary.items()}
    return [back[t] for t in index.sequences[0].tolist()]


def test_tables(spark, case):
    items, docs, want = case
    bench = spark.createDataFrame([*items, (99, "too short here"), (98, None), items[0]], "item_id long, text string")
    table = spark.createDataFrame([(d, t, "x") for d, t in docs] + [(500, None, "y"), (None, docs[0][1], "z")], "doc_id long, text string, item_id string").repartition(3)
    for block in (2_000_000, 2_000):
        rows = dc.find_contamination(table.drop("item_id"), bench, block_chars=block).collect()
        got = {(r.doc_id, r.item_id) for r in rows if r.doc_id is not None}
        assert got <= set(want) and len(got) >= 0.93 * len(want)
    kept = dc.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 500 in ids and not ids & {d for (d, _), v in want.items() if v == 0}
    assert {d for d, _ in docs} - ids <= {d for d, _ in want}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert dc.find_contamination(docs, none).collect() == [] and dc.drop_contaminated(docs, none).count() == 1
    assert dc.find_contamination(docs.limit(0), none).collect() == []


def test_a_text_that_begins_or_ends_inside_an_item_is_the_one_reported():
    rng = random.Random(12)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(8)]
    clean = " ".join(prose(40, rng))
    texts, want = [], {}
    for i, item in items:
        own = item.split()
        for cut in (own[1:], own[3:], own[:-3]):
            want[len(texts) + 1, i] = (0, len(cut), 30 - len(cut))
            texts += [clean, " ".join(cut), ""]
    index = dc.Index(items)
    got = {(t, i): (s, e, d) for t, i, s, e, d in index.scan(texts)}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("length", [7, 20, 110, 279])
def test_recall_meets_the_target_at_every_length_and_place_of_edits(length):
    rng = random.Random(length)
    own = [[f"w{rng.randrange(3000)}" for _ in range(length)] for _ in range(60)]
    index = dc.Index([(i, " ".join(w)) for i, w in enumerate(own)])
    assert all(c.recall >= 0.97 for c in index.classes)
    k = dc.allowed(length, 0.8)
    for part in (1, 3):
        texts = []
        for w in own:
            at = max(k, length // part)
            texts.append(" ".join([*prose(20, rng), *edited(w[:at], k, rng), *w[at:], *prose(20, rng)]))
        want = {(i, i) for i, w in enumerate(own) if brute_distance(w, texts[i].split()) <= k}
        got = {(t, i) for t, i, *_ in index.scan(texts)}
        assert len(want) == 60 and len(got & want) >= 56
        assert got & want == want or not all(c.exact for c in index.classes)
