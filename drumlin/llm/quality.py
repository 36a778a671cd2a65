"""Operator 5, quality rules: distribution divergence.

A document's histogram of character classes and its histogram of common words are held
against those of its language with the Jensen-Shannon divergence (base 2, so in 0..1).
The references are pooled over the documents of the language that are long enough and whose
characters are those of prose: letters, spaces, signs and the rest in about the shares that
prose in any alphabet has, so junk never makes the reference, however much of it there is. A
language without such a document is judged by prose itself. Short texts have noisy
histograms, so a minimum length guards each test. Everything is built-in functions; texts
are counted once, the counters written, and the only shuffle is the sum of some twenty
counters by language.

Defined cases. Null text counts as empty: no words, so it fails the base rules. Null
language is a language of its own. A language without a word list is judged by its
character classes only. Repeated rows are judged alike, each on its own. An empty table
gives an empty result. Extra columns of any name are kept; in quality_rules() one that
bears the name of a result gives way to it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drumlin.llm.common import SPACE, free_name, let, materialize, words_of

# The commonest function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "with", "be", "by", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour", "qui", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no"],
}
# The base rules.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Classes in the order in which they are taken out of the text, after white space.
CLASSES = [
    ("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"),
    ("punct", r"[.,;:!?'\"()\-]+"), ("letter", r"\p{L}+"),
]
CHAR_BINS = ["space", *(name for name, _ in CLASSES), "other"]
REFERENCE_LIMIT = 50_000
# The usual shares of kinds of characters in prose, and how far from them a
# document that makes a reference may be.
PROSE = {"letters": 0.80, "space": 0.165, "digit": 0.005, "symbol": 0.001, "punct": 0.026, "other": 0.003}
PROSE_LIMIT = 0.05
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_divergence", "word_divergence", "kept")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Most texts repeat none, which one distinct
    count tells; only the others sort their windows."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: let(
            F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a["h"] == b["h"]),
            lambda same: let(
                F.sort_array(F.transform(
                    F.filter(s, lambda x, j: F.coalesce(F.get(same, j), F.lit(False)) | F.coalesce(F.get(same, j - 1), F.lit(False))),
                    lambda x: x["i"],
                )),
                lambda at: F.aggregate(
                    F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))),
                    F.lit(WINDOW), lambda total, step: total + step,
                ),
            ),
        ))

    def count(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
        return let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(count(w))).cast("long")


def _histograms(docs: DataFrame, text: str, lang: str, common: dict[str, list[str]]) -> tuple[DataFrame, dict[str, str]]:
    """Adds what both passes need: words and the counters of both histograms.

    The classes are taken out of the text one after another, so each pattern scans what
    the ones before have left and a class costs the difference of two lengths."""
    names = {k: free_name(docs, f"__{k}") for k in ["text", "words", "common", "list", *(f"s{i}" for i in range(len(CLASSES) + 1))]}
    known = sorted({w for ws in common.values() for w in ws})
    per_lang = F.lit(None).cast("array<string>")
    for code, ws in common.items():
        per_lang = F.when(F.col(f"`{lang}`") == code, F.array(*map(F.lit, ws))).otherwise(per_lang)
    df = docs.withColumn(names["text"], F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumns({names["words"]: words_of(F.col(names["text"])), names["s0"]: F.regexp_replace(names["text"], SPACE + "+", ""), names["list"]: per_lang})
    # The common words as one string, each between spaces of its own: a word's count is what
    # the string loses when the word is replaced by nothing.
    df = df.withColumn(names["common"], F.concat(F.lit(" "), F.array_join(F.filter(names["words"], lambda w: w.isin(known)), "  "), F.lit(" ")))
    for i, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(names[f"s{i + 1}"], F.regexp_replace(names[f"s{i}"], pattern, ""))
    bins = max(map(len, common.values()))
    counters = {"n_words": F.size(names["words"]), "word_chars": F.length(names["s0"]), "c_space": F.length(names["text"]) - F.length(names["s0"])}
    for i, (kind, _) in enumerate(CLASSES):
        counters[f"c_{kind}"] = F.length(names[f"s{i}"]) - F.length(names[f"s{i + 1}"])
    counters["c_other"] = F.length(names[f"s{len(CLASSES)}"])
    for j in range(bins):
        word = F.get(F.col(names["list"]), F.lit(j))
        lost = F.octet_length(names["common"]) - F.octet_length(F.replace(F.col(names["common"]), F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))
        counters[f"w_{j}"] = F.coalesce(F.floor(lost / (F.octet_length(word) + 2)), F.lit(0))
    for k in counters:
        names[k] = free_name(docs, f"__{k}")
    df = df.withColumns({names[k]: c.cast("long") for k, c in counters.items()})
    names["w_rest"] = free_name(docs, "__w_rest")
    df = df.withColumn(names["w_rest"], F.col(names["n_words"]) - sum((F.col(names[f"w_{j}"]) for j in range(bins)), F.lit(0)))
    names |= {"bins": str(bins)}
    return df, names


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
    return let(counts, lambda v: let(total, lambda t: F.transform(v, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0)))))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two histograms, given as arrays of counts."""

    def term(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(F.lit(0.0))

    return F.aggregate(F.zip_with(_shares(p), _shares(q), lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2)), F.lit(0.0), lambda t, x: t + x) / 2


def _far_from_prose(names: dict[str, str]) -> Column:
    """The divergence of a document's kinds of characters from those of prose."""
    of = {"letters": ("lower", "upper", "letter")} | {k: (k,) for k in PROSE if k != "letters"}
    counts = F.array(*(sum((F.col(names[f"c_{c}"]) for c in of[k]), F.lit(0)).cast("double") for k in PROSE))
    return jensen_shannon(counts, F.array(*map(F.lit, PROSE.values())))


def _pooled(counted: DataFrame, lang: str, names: dict[str, str], min_chars: int) -> DataFrame:
    keys = _keys(names)
    clean = counted.where((F.col(names["word_chars"]) >= min_chars) & (F.col(names["prose"]) <= PROSE_LIMIT))
    return clean.groupBy(F.col(f"`{lang}`").alias("ref_lang")).agg(*(F.sum(names[k]).alias(f"ref_{k}") for k in keys))


def _keys(names: dict[str, str]) -> list[str]:
    return [f"c_{k}" for k in CHAR_BINS] + [f"w_{j}" for j in range(int(names["bins"]))] + ["w_rest"]


def language_references(docs: DataFrame, *, text: str = "text", lang: str = "lang", common: dict[str, list[str]] = COMMON_WORDS, min_chars: int = 200) -> DataFrame:
    """Histograms pooled over the documents that read like prose: one row for each language."""
    df, names = _histograms(docs, text, lang, common)
    names["prose"] = free_name(df, "__prose")
    return _pooled(df.withColumn(names["prose"], _far_from_prose(names)), lang, names, min_chars)


def count_all(docs: DataFrame, *, text: str = "text", lang: str = "lang", common: dict[str, list[str]] = COMMON_WORDS, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with every counter, in one pass over the texts, and the counters' names."""
    df, names = _histograms(docs, text, lang, common)
    lines = F.filter(F.split(F.col(names["text"]), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    names |= {k: free_name(df, f"__{k}") for k in ("repeat", "dup", "prose", "has_list")}
    df = df.withColumns({
        names["repeat"]: repeated_words(F.col(names["words"])), names["dup"]: let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long"),
        names["prose"]: _far_from_prose(names), names["has_list"]: F.col(names["list"]).isNotNull(),
    })
    own = [c for c in docs.columns if keep_text or c != text]
    return df.select(*(F.col(f"`{c}`") for c in own), *(names[k] for k in (*_keys(names), "n_words", "word_chars", "repeat", "dup", "prose", "has_list"))), names


def quality_rules(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", common: dict[str, list[str]] = COMMON_WORDS, keep_text: bool = True,
    references: DataFrame | None = None, min_chars: int = 200, min_words: int = 80, max_char_divergence: float = 0.08, max_word_divergence: float = 0.08,
) -> DataFrame:
    """`docs` with the counters of the base rules, both divergences, base_failed and kept.

    A document is kept when it passes the base rules and neither divergence from its
    language's reference exceeds its bound; a divergence counts only from `min_chars`
    characters or `min_words` words on. `references` replaces the pooled histograms; a
    language that has none is held against prose, its words against nothing."""
    counted, names = count_all(docs, text=text, lang=lang, common=common, keep_text=keep_text)
    counted = materialize(counted, "quality-counters")
    refs = _pooled(counted, lang, names, min_chars) if references is None else references
    ref_names = {c: free_name(counted, f"__{c}") for c in refs.columns}
    refs = refs.select(*(F.col(c).alias(n) for c, n in ref_names.items()))
    refs = materialize(refs, "quality-references")
    if refs.count() <= REFERENCE_LIMIT:
        refs = F.broadcast(refs)
    df = counted.join(refs, F.col(f"`{lang}`").eqNullSafe(F.col(ref_names["ref_lang"])), "left")
    chars = [f"c_{k}" for k in CHAR_BINS]
    word_bins = [k for k in _keys(names) if k not in chars]
    divergence = {
        k: jensen_shannon(F.array(*(F.col(names[b]).cast("double") for b in bins)), F.array(*(F.coalesce(F.col(ref_names[f"ref_{b}"]), F.lit(0)).cast("double") for b in bins)))
        for k, bins in (("char", chars), ("word", word_bins))
    }
    known = F.col(ref_names["ref_c_space"]).isNotNull()
    divergence = {"char": F.when(known, divergence["char"]).otherwise(F.col(names["prose"])), "word": F.when(known, divergence["word"]).otherwise(F.lit(0.0))}
    failed = (F.col(names["n_words"]) < MIN_WORDS) | (100 * F.col(names["repeat"]) > MAX_REPEAT_PERCENT * F.col(names["n_words"]))
    far = ((F.col(names["word_chars"]) >= min_chars) & (divergence["char"] > max_char_divergence)) | ((F.col(names["n_words"]) >= min_words) & F.col(names["has_list"]) & (divergence["word"] > max_word_divergence))
    return df.select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED and (keep_text or c != text)),
        F.col(names["n_words"]).alias("n_words"), F.col(names["word_chars"]).alias("word_chars"), F.col(names["c_symbol"]).alias("n_symbols"),
        F.col(names["dup"]).alias("n_dup_lines"), F.col(names["repeat"]).alias("n_repeat_words"), failed.alias("base_failed"),
        divergence["char"].alias("char_divergence"), divergence["word"].alias("word_divergence"), (~(failed | far)).alias("kept"),
    )


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that quality_rules() keeps, with their own columns only.

    Columns of `docs` that bear the name of a counter keep their own values."""
    aside = {c: free_name(docs, f"__own_{c}") for c in docs.columns if c.lower() in ADDED}
    scored = quality_rules(docs.withColumnsRenamed(aside), **options)
    return scored.where("kept").select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def divergence_of(p: list[float], q: list[float]) -> float:
    """The same figure in plain Python, for tests and for choosing bounds."""
    sp, sq = sum(p) or 1, sum(q) or 1
    total = 0.0
    for a, b in zip(p, q, strict=True):
        a, b = a / sp, b / sq
        for x in (a, b):
            if x > 0:
                total += x * math.log2(x / ((a + b) / 2))
    return total / 2
