import random

import pytest

from drumlin.llm import linededup as ld


def line(rng, lo=1, hi=15):
    return " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(lo, hi)))


def corpus():
    rng = random.Random(9)
    passages = [[line(rng, 5, 15) for _ in range(rng.randrange(4, 12))] for _ in range(4)] + [[line(rng, 60, 70)]]
    docs = []
    for d in range(60):
        lines = [line(rng) for _ in range(rng.randrange(0, 12))]
        for p in passages:
            if rng.random() < 0.3:
                at = rng.randrange(len(lines) + 1)
                lines[at:at] = p if rng.random() < 0.8 else [*p[:2], "", *p[2:]]
        docs.append((d, "\n".join(lines)))
    return docs, passages


def words(x):
    return len(x.split())


def naive(docs, least=50):
    """What may and must go: lines in a run of `least` words that an earlier place has."""
    seqs = [(d, [(i, x) for i, x in enumerate((t or "").split("\n")) if x.split()]) for d, t in docs]
    gone = {d: set() for d, _ in docs}
    for n, (d, own) in enumerate(seqs):
        for m in range(n + 1):
            other = seqs[m][1]
            for shift in range(-len(other) + 1, len(own)):
                if m == n and shift <= 0:
                    continue
                a = 0
                while a < len(own):
                    b = a
                    while b < len(own) and 0 <= b - shift < len(other) and own[b][1] == other[b - shift][1]:
                        b += 1
                    if b > a and sum(words(x) for _, x in own[a:b]) >= least:
                        gone[d].update(range(own[a][0], own[b - 1][0] + 1))
                    a = max(b, a + 1)
    return gone


def test_against_naive(spark):
    docs, _ = corpus()
    docs += [(60, docs[3][1]), (61, "\n".join(["one two three four five"] * 30)), (62, ""), (63, None)]
    want = naive(docs)
    rows = {r.doc_id: r for r in ld.line_dedup_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert len(rows) == len(docs)
    least = repeated_windows(docs)
    for d, t in docs:
        runs = [tuple(map(int, x.split(":"))) for x in rows[d].runs.split(",") if x]
        got = {i for a, b in runs for i in range(a, b + 1)}
        assert got == want[d] and least[d] <= got, d
        lines = (t or "").split("\n")
        assert rows[d].n_deleted == len(got)
        assert rows[d].text == (None if t is None else t if not got else "\n".join(x for i, x in enumerate(lines) if i not in got))


def repeated_windows(docs, least=50):
    """What must go: windows of `least` words that an earlier place has."""
    seen, gone = set(), {}
    for d, t in docs:
        own, gone[d] = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.split()], set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(words(x) for _, x in own[a:b]) >= least:
                    key = tuple(x for _, x in own[a:b])
                    if key in seen:
                        gone[d].update(i for i, _ in own[a:b])
                    seen.add(key)
                    break
    return gone


@pytest.mark.parametrize("seed", range(5))
def test_shared_run_shares_a_fingerprint(seed):
    rng = random.Random(seed)
    for _ in range(50):
        shared = [line(rng) for _ in range(rng.randrange(1, 30))]
        if sum(map(words, shared)) < 50:
            continue
        a, b = ([line(rng) for _ in range(rng.randrange(6))] for _ in range(2))
        x, y = ("\n".join([*h, *shared, *t]) for h, t in ((a, b), (b, a)))
        assert {p[1] for p in ld.fingerprints(*ld.hash_lines(x)[:2], 25, 50)} & {p[1] for p in ld.fingerprints(*ld.hash_lines(y)[:2], 25, 50)}


def test_keeps_columns_and_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, f"a\n{long}\nb", 1, "q"), (1, f"{long}\nc", 2, "q"), (1, f"{long}\nc", 3, "q"), (None, "x", 4, None)], "doc_id long, text string, row int, runs string")
    got = {r.row: r.text for r in ld.drop_repeated_lines(docs).collect()}
    assert ld.drop_repeated_lines(docs).columns == docs.columns
    assert got[1] == "a\nb" and got[4] == "x" and got[2] == got[3] == f"{long}\nc"
    assert ld.line_dedup_report(docs.limit(0)).collect() == []


def test_runs_that_only_a_later_document_shares(spark):
    rng = random.Random(4)
    head, tail = [line(rng, 8, 12) for _ in range(8)], [line(rng, 8, 12) for _ in range(4)]
    long = [line(rng, 60, 61) for _ in range(3)]
    docs = [
        (1, "\n".join(head)), (2, "\n".join([*head, *tail])), (3, "\n".join([*head, *tail, "its own line"])),
        (4, "\n".join([long[0], "x", long[1]])), (5, "\n".join([long[0], "", long[1], "", long[2]])), (6, "\n".join([long[0], "", long[1], "", "", long[2]])),
    ]
    rows = {r.doc_id: r.text for r in ld.line_dedup_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = naive(docs)
    for d, t in docs:
        assert rows[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])
    assert rows[3] == "its own line" and rows[2] == "\n".join(tail)


def test_ids_that_hold_separators(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("a|b", long, 1), ("a", "b|" + long, 2), (None, long, 3), ("-", long, 4), ("", long, 5)], "doc_id string, text string, n int")
    assert {r.n: r.text for r in ld.drop_repeated_lines(docs).collect()} == {3: long, 5: "", 4: "", 1: "", 2: "b|" + long}
    docs = spark.createDataFrame([("a|b", long + "\n" + long, 1), ("a", "b|" + long + "\n" + long, 2)], "doc_id string, text string, n int")
    assert {r.n: r.text for r in ld.drop_repeated_lines(docs).collect()} == {2: "b|" + long + "\n" + long, 1: ""}


def test_one_very_long_text(spark):
    rng = random.Random(8)
    passage = [line(rng, 8, 12) for _ in range(8)]
    lines = [line(rng, 3, 9) + f" {i}" for i in range(30_000)]
    docs = [(1, "\n".join([*lines[:15_000], *passage, *lines[15_000:]])), (2, "\n".join(["a", *passage, "b"])), (3, "\n".join(lines))]
    rows = {r.doc_id: r for r in ld.line_dedup_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].n_deleted == 0 and rows[2].text == "a\nb" and rows[3].n_deleted == 30_000
