import math
import re
from collections import Counter

import pytest

from drumlin.llm import quality as Q

LOREM = "the cat and the dog went to the house of a friend in the town, and it was good for them to be with the others that day. "
SECOND = "She had not been there since the winter, when he and his brother left for the coast on a ship of their father; by now it is old, and in need of repair."
TEXTS = [
    None, "", "   \n\t ", "one two three", LOREM * 1, "a b c d e f g h i j", "x y z w v " * 3, "line\nline\n\nline \nother\n \n ", "#$%&*<>|" * 20, "word " * 5000,
    "é à ü ñ " * 30, LOREM + "\n" + LOREM, "\x0b\x0ca\x1cb c", "The quick brown fox jumps over the lazy dog and runs away\n" * 2, " ".join(f"w{i}" for i in range(20_000)),
]


def counters(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_counters(spark):
    docs = spark.createDataFrame([(i, t, "en", 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int, kept string")
    rows = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        n, *rest = counters(t)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest), i
        assert r.base_failed == (n < 10 or 100 * rest[3] > 20 * n)
        assert not (r.base_failed and r.kept)


def histograms(text, lang):
    t = text or ""
    left = re.sub(r"[\x20\x09-\x0D]+", "", t)
    chars = [len(t) - len(left)]
    for pattern in ("[a-z]", "[A-Z]", "[0-9]", "[#*$%&|<>]", r"[.,;:!?'\"()\-]", r"[^\W\d_]"):
        kept = re.sub(pattern, "", left)
        chars.append(len(left) - len(kept))
        left = kept
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    known = Q.COMMON_WORDS.get(lang) or [None] * 14
    bins = [words.count(w) for w in known]
    return [*chars, len(left)], [*bins, len(words) - sum(bins)]


def test_divergence_against_plain_python(spark):
    docs = [(i, t, ("en", "de", None, "zz")[i % 4]) for i, t in enumerate(TEXTS)]
    rows = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    refs = {}
    for _, t, lang in docs:
        if prose_of(t, lang) <= Q.PROSE_LIMIT and counters(t)[1] >= 200:
            for k, h in enumerate(histograms(t, lang)):
                refs[lang, k] = [a + b for a, b in zip(refs.get((lang, k), [0] * len(h)), h, strict=True)]
    assert 0 < len(refs) < 8
    for i, t, lang in docs:
        for k, name in enumerate(("char_divergence", "word_divergence")):
            want = Q.divergence_of(histograms(t, lang)[k], refs[lang, k]) if (lang, k) in refs else 0 if k else prose_of(t, lang)
            assert math.isclose(rows[i][name], want, abs_tol=1e-9)


def prose_of(text, lang):
    space, lower, upper, digit, symbol, punct, letter, other = histograms(text, lang)[0]
    return Q.divergence_of([lower + upper + letter, space, digit, symbol, punct, other], list(Q.PROSE.values()))


def test_junk_never_makes_the_reference(spark):
    junk = [(i, " ".join(f"w{i}%%% a{i}### {j}" for j in range(60)), "en") for i in range(300)]
    lone = [(1000, " ".join(f"{j}%%% ###{j}" for j in range(200)), "xx"), (1001, "Слово и ещё одно слово, и так далее до конца. " * 3 + " ".join(f"слово{j}" for j in range(40)), "ru")]
    prose = [(2000 + i, LOREM.replace("cat", f"cat{i}").replace("dog", f"dog{i} x{i * 7}") + SECOND.replace("ship", f"ship{i}"), "en") for i in range(20)]
    docs = spark.createDataFrame([*junk, *lone, *prose], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in Q.quality_filter(docs).collect()}
    clean = {r[0] for r in prose if 100 * counters(r[1])[4] <= 20 * counters(r[1])[0]}
    assert clean and clean <= kept and not kept & {r[0] for r in [*junk, lone[0]]}


def test_clashing_columns(spark):
    names = ["__has_list", "__text", "__words", "__n_words", "__repeat", "__dup", "__prose", "__ref_lang", "ref_lang", "kept", "n_words", "__own_kept", "prose", "__c_space"]
    docs = spark.createDataFrame([(1, LOREM * 2, "en", *range(len(names)))], ["doc_id", "text", "lang", *names])
    assert set(names) <= set(Q.quality_rules(docs).columns) and Q.quality_rules(docs).first().n_words == counters(LOREM * 2)[0]
    assert Q.quality_filter(docs).columns == docs.columns and Q.quality_filter(docs).collect() == []


def test_filter_keeps_clean_prose(spark):
    clean = [(i, LOREM.replace("cat", f"cat{i}").replace("dog", f"dog{i} x{i * 7}"), "en") for i in range(40)]
    symbols = (100, " ".join(f"w{i}%%% a{i}###" for i in range(120)), "en")
    lists = (101, " | ".join(f"Word{i}" for i in range(120)), "en")
    short = (102, "too short", "en")
    docs = spark.createDataFrame([(*r, r[0]) for r in [*clean, *clean[:3], symbols, lists, short, (103, None, None)]], "doc_id long, text string, lang string, n_words long")
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} == set(range(40)) and len(rows) == 43 and all(r.n_words == r.doc_id for r in rows)


def test_own_references_and_empty(spark):
    docs = spark.createDataFrame([(1, LOREM, "en")], "doc_id long, text string, lang string")
    refs = Q.language_references(docs, min_chars=10)
    assert Q.quality_rules(docs, references=refs).first().char_divergence == pytest.approx(0)
    assert Q.quality_rules(docs.limit(0)).collect() == [] and Q.quality_filter(docs.limit(0)).collect() == []


def test_native(spark):
    docs = spark.createDataFrame([(1, LOREM, "en")], "doc_id long, text string, lang string")
    for df in (Q.quality_rules(docs), Q.quality_filter(docs), Q.count_all(docs)[0]):
        assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
