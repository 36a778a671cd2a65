"""Operator 9, line dedup by winnowing.

A document is the sequence of its lines that hold a word. A gram is the shortest run of
lines from a given line that holds `gram_words` words; a window is the shortest run from a
line, or up to a line, that holds `min_words` words, and of the grams inside a window the one
with the least hash is its fingerprint (the last one in a tie). Two documents that share a
run of `min_words` words or more share whole windows and hence their fingerprints.

Only places whose fingerprint occurs twice go on. Their windows are joined to the first
place that has the same window (by document id, then row, then line), so a match holds
`min_words` words from the start. Matches of one pair of documents on one diagonal are
extended line by line both ways, and the later run goes. A window meets its first place
only, so a passage in n documents costs n rows, not n * n. A run that only some other
earlier document shares goes all the same, as each of its lines lies in a window of its own
that has an earlier place: the result is that of comparing all pairs of documents.

A document is known by a digest of its id and text, computed wherever it is read, so no
copy of the texts is written. Lines are compared by 64-bit hashes. Joins and minima by fingerprint pre-aggregate or
stand where Spark splits a hot key; what is gathered is one document's matches with one
other, or one document's deletions.

Defined cases. Null and empty texts stay as they are. Repeated rows, equal in id and text,
are one document: each keeps what the first keeps. Equal texts under other ids are later
copies and lose all of a long enough text. Within one document a later repeat goes too,
overlapping runs included. Lines without words never match; they go when they lie inside a
deleted run. A null id sorts first. An empty table gives an empty result. Extra columns of
any name are kept by drop_repeated_lines()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.llm.common import free_name, in_slices, let, materialize

LONG = pa.list_(pa.int64())


def hash_lines(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Hashes, word counts and raw line numbers of the lines that hold a word."""
    import xxhash

    hashes, counts, at = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        n = len(line.encode().split()) if line else 0  # bytes split on ASCII white space only
        if n:
            hashes.append(xxhash.xxh64_intdigest(line) - (1 << 63))
            counts.append(n)
            at.append(i)
    return hashes, counts, at


def ends_of(counts: np.ndarray, words: int) -> np.ndarray:
    """For each line the end of the shortest run from it with `words` words; -1 if none."""
    total = np.concatenate([[0], np.cumsum(counts)])
    ends = np.searchsorted(total, total[:-1] + words, side="left")
    return np.where(ends < len(total), ends, -1)


def runs_to_match(counts: np.ndarray, at: list[int], min_words: int) -> list[tuple[int, int]]:
    """The runs (start, end) that are looked for elsewhere, all of `min_words` words or more:
    the shortest from each line, the shortest up to each line, and two lines around blank
    ones if one of them is a run by itself.

    A longer run is their union: what lies before the end of the first shortest run of it is
    in that, any later line ends a shortest run inside it."""
    total = np.concatenate([[0], np.cumsum(counts)])
    ends = ends_of(counts, min_words)
    runs = {(i, e) for i, e in enumerate(ends.tolist()) if e >= 0}
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    runs |= {(i, j + 1) for j, i in enumerate(starts.tolist()) if i >= 0}
    alone = counts >= min_words
    runs |= {(int(i), int(i) + 2) for i in np.flatnonzero(alone[:-1] | alone[1:]) if at[i + 1] > at[i] + 1}
    return sorted(runs)


def fingerprints(hashes: list[int], counts: list[int], gram_words: int, min_words: int, at: list[int] | None = None) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(line, fingerprint, windows): the least gram of each window, each place once, with the
    windows (line, hash of all their lines) that chose it."""
    if sum(counts) < min_words:
        return []
    import xxhash

    sizes = np.array(counts)
    grams = ends_of(sizes, gram_words)
    raw = np.array(hashes, dtype=np.int64).tobytes()
    value = [xxhash.xxh64_intdigest(raw[8 * i : 8 * e]) - (1 << 63) if e >= 0 else None for i, e in enumerate(grams.tolist())]
    chosen: dict[int, list[tuple[int, int]]] = {}
    for i, end in runs_to_match(sizes, at or list(range(len(counts))), min_words):
        # Grams inside lines i..end-1; starts go up with their ends, and i itself is always inside.
        best = i
        for j in range(i + 1, end):
            if grams[j] < 0 or grams[j] > end:
                break
            if value[j] <= value[best]:
                best = j
        chosen.setdefault(best, []).append((i, xxhash.xxh64_intdigest(raw[8 * i : 8 * end], 1) - (1 << 63)))
    return [(j, value[j], w) for j, w in sorted(chosen.items())]


def extend(own: list[int], other: list[int], own_counts: list[int], matches: list[tuple[int, int]], same: bool, min_words: int) -> list[tuple[int, int]]:
    """Runs (first, last) of `own` lines that repeat lines of `other`, from matched places."""
    runs, reached = [], {}
    for i, j in sorted(matches):
        shift = i - j
        if i <= reached.get(shift, -1):
            continue
        a, b = i, i
        while a > 0 and a - 1 - shift >= 0 and own[a - 1] == other[a - 1 - shift]:
            a -= 1
        while b + 1 < len(own) and b + 1 - shift < len(other) and own[b + 1] == other[b + 1 - shift]:
            b += 1
        reached[shift] = b
        if sum(own_counts[a : b + 1]) >= min_words:
            runs.append((a, b))
    return runs


def repeated_runs(rows: DataFrame, *, gram_words: int, min_words: int) -> DataFrame:
    """(row, runs): raw line ranges to delete, from a table (row, id, text); `row` is a string."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            got = [hash_lines(t) for t in batch.column(2).to_pylist()]
            prints = [fingerprints(h, c, gram_words, min_words, a) for h, c, a in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), *(pa.array([g[k] for g in got], LONG) for k in range(3)),
                    pa.array([[v for _, v, ws in x for _ in ws] for x in prints], LONG), pa.array([[k == 0 for *_, ws in x for k in range(len(ws))] for x in prints], pa.list_(pa.bool_())),
                    pa.array([[i for *_, ws in x for i, _ in ws] for x in prints], LONG), pa.array([[w for *_, ws in x for _, w in ws] for x in prints], LONG),
                ],
                names=["row", "id", "hashes", "counts", "at", "print", "fresh", "start", "window"],
            )

    id_type = dict(rows.dtypes)["id"]
    read = rows.mapInArrow(lines, f"row string, id {id_type}, hashes array<long>, counts array<long>, at array<long>, print array<long>, fresh array<boolean>, start array<long>, window array<long>")
    read = materialize(read.where(F.size("print") > 0), "lines")
    # A place counts once, by its first window, however many windows chose it.
    each = read.select("row", "id", F.explode(F.arrays_zip("print", "fresh", "start", "window")).alias("x")).select("row", "id", "x.*")
    shared = each.where("fresh").groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    shared = materialize(shared, "shared")  # alone, so that Spark may split the rows of a common one
    windows = each.join(shared, "print", "left_semi").select("row", "id", "start", "window")
    windows = materialize(windows, "windows")
    first = windows.groupBy("window").agg(F.min(F.struct("id", "row", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("window", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")), "first")
    pairs = windows.join(first, "window").where("row <> first_row or start <> first_start")
    pairs = pairs.groupBy("row", "first_row").agg(F.collect_list(F.struct("start", "first_start")).alias("matches"))
    own = read.select("row", "hashes", "counts", "at").dropDuplicates(["row"])
    asked = first.select(F.col("first_row").alias("row")).distinct()
    other = read.join(asked, "row", "left_semi").select(F.col("row").alias("first_row"), F.col("hashes").alias("first_hashes")).dropDuplicates(["first_row"])
    other = materialize(other, "firsts")  # alone, so that Spark may split what a first place's copies ask
    both = pairs.join(own, "row").join(other, "first_row").select("row", "first_row", "matches", "hashes", "counts", "at", "first_hashes")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out_rows, starts, ends = [], [], []
            for r in batch.to_pylist():
                matches = [(m["start"], m["first_start"]) for m in r["matches"]]
                for a, b in extend(r["hashes"], r["first_hashes"], r["counts"], matches, r["row"] == r["first_row"], min_words):
                    out_rows.append(r["row"])
                    starts.append(r["at"][a])
                    ends.append(r["at"][b])
            yield pa.RecordBatch.from_arrays([pa.array(out_rows, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["row", "start", "end"])

    found = both.mapInArrow(ranges, "row string, start long, end long")
    return found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", gram_words: int = 25, min_words: int = 50) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its cleaned text, deleted runs, numbers of lines and of deleted lines, and
    the names of those columns."""
    names = {k: free_name(docs, f"__{k}") for k in ("row", "clean", "runs", "n_lines", "n_deleted")}
    # The id's length stands before it, so no id and text run into one another; a null id has none.
    own_id = F.col(f"`{id_col}`").cast("string")
    key = F.md5(F.concat(F.coalesce(F.octet_length(own_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(own_id, F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary"))
    rows = docs.select(key.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = materialize(repeated_runs(rows, gram_words=gram_words, min_words=min_words), "runs").toDF(names["row"], names["runs"])
    # Always by a shuffle: deletions grow with the corpus, and a plan that broadcasts them
    # while they are few would tell nothing of the plan at scale.
    joined = docs.withColumn(names["row"], key).join(runs.hint("merge"), names["row"], "left")
    held = F.col(names["runs"])
    inside = lambda i: F.exists(held, lambda r: (i >= r["start"]) & (i <= r["end"]))
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    clean = F.when(held.isNull(), F.col(f"`{text}`")).otherwise(F.array_join(let(lines, lambda v: F.filter(v, lambda x, i: ~inside(i))), "\n"))
    deleted = F.when(held.isNull(), F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), F.lit(0), lambda n, i: n + F.when(inside(i), 1).otherwise(0)))
    return joined.withColumns({names["clean"]: clean, names["n_lines"]: F.coalesce(F.size(lines), F.lit(0)).cast("long"), names["n_deleted"]: deleted.cast("long")}), names


def line_dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_deleted, runs (start:end, raw lines,
    ends included, comma-joined) and the cleaned text."""
    out, names = dedup_lines(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), id_col=id_col, text=text, **options)
    shown = F.array_join(F.transform(names["runs"], lambda r: F.concat(r["start"], F.lit(":"), r["end"])), ",")
    return out.select(F.col(f"`{id_col}`"), F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_deleted"]).alias("n_deleted"), F.coalesce(shown, F.lit("")).alias("runs"), F.col(names["clean"]).alias("text"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the repeated runs deleted from `text`."""
    out, names = dedup_lines(docs, id_col=id_col, text=text, **options)
    return out.select(*(F.col(names["clean"]).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
