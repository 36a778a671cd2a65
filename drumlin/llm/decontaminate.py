"""Operator 7, benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words (lower-cased \\w+). A document holds a benchmark item if some
stretch of it is within a word edit distance of (1 - similarity) times the item's length.
The CGK embedding walks along a sequence: each step emits the word under the pointer, and a
random bit of step and word says whether the pointer moves on. Two sequences at a small
edit distance give outputs at a small Hamming distance, since their walks fall in step
again after each edit. Sampled output positions are the keys of a locality-sensitive hash;
several walks with several samples each are made until edited copies of the items, at the
largest distance allowed, are found at the target recall. The recall is measured on fresh
copies of every item when the index is built, with the edits anywhere and with all of them in the first third.
A class of items that misses the target at `MOST_KEYS` keys has none: its items are cut
into one piece more than edits are allowed, so every match holds some piece unchanged, and
all places of all pieces are looked up, which finds every match. What a key or a piece finds
is verified by the exact edit distance, so nothing false stays.

Windows have the size of the items: items of near lengths form a class with one window.
Every position of every whole document starts a window of every class, unless the words of
the window that occur in an item of the class are too few for the edit distance allowed, which rules
out no match. Documents are scanned where they lie, without a shuffle; the index is built
from one block of items of bounded size, and a larger benchmark is scanned in blocks.

Defined cases. Null or empty documents hold nothing. Items under `min_words` words (five)
are ignored, as any prose would match them. Repeated rows are reported each; a document
that holds an item twice reports its best place. An empty table on either side gives an
empty result. Ids are of any type that can be ordered. Extra columns of any name are kept by
drop_contaminated()."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from drumlin.llm.common import in_slices

WORD = re.compile(r"\w+")
BLOCK_CHARS = 2_000_000
WALKS, SAMPLED, MOST_KEYS = 3, 3, 192
SCHEMA = "item_id {}, start_word int, end_word int, distance int, similarity double"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def allowed(length: int, similarity: float) -> int:
    return math.floor((1 - similarity) * length + 1e-9)


def mix64(x: np.ndarray) -> np.ndarray:
    """A public integer finalizer (splitmix64): each bit of the result depends on all of x."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class LengthClass:
    """Items whose lengths round down to `size` words, and their keys."""

    size: int
    items: list[int] = field(default_factory=list)
    slack: int = 0
    needed: int = 0
    keys: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)  # walk, sampled steps, multipliers
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # sorted keys, items
    holds: np.ndarray | None = None  # by word: whether an item of the class has it
    recall: float = 0.0  # on fresh copies; 1 where the class is searched by pieces
    exact: bool = False


class Index:
    """The index of one block of items; it is sent to every executor."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = 0.8, target_recall: float = 0.97, min_words: int = 5, seed: int = 11):
        self.similarity, self.seed = similarity, seed
        self.ids, self.vocabulary, self.sequences = [], {}, []
        for item_id, text in items:
            found = words(text)
            if len(found) >= min_words:
                self.ids.append(item_id)
                self.sequences.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], dtype=np.int32))
        self.pad = len(self.vocabulary) + 1
        by_size: dict[int, LengthClass] = {}
        for i, s in enumerate(self.sequences):
            size = min_words
            while round(size * 1.25) + (size < 8) <= len(s):
                size = round(size * 1.25) + (size < 8)
            by_size.setdefault(size, LengthClass(size)).items.append(i)
        self.classes = [by_size[k] for k in sorted(by_size)]
        self.longest = max((len(s) for s in self.sequences), default=0)
        rng = np.random.default_rng(seed)
        for c in self.classes:
            c.slack = max(allowed(len(self.sequences[i]), similarity) for i in c.items)
            # Of the first size - k words of a match at least size - 2k are the item's.
            c.needed = max(1, c.size - 2 * c.slack)
            c.holds = np.zeros(self.pad + 1, dtype=bool)
            for i in c.items:
                c.holds[self.sequences[i]] = True
            self._build(c, rng, target_recall)
        self.pieces = self._pieces([i for c in self.classes if c.exact for i in c.items], rng)

    def walk_bits(self, walk: int, steps: int) -> list[np.ndarray]:
        tokens = np.arange(self.pad + 1, dtype=np.uint64) * np.uint64(0x100000001B3)
        return [mix64(tokens + np.uint64((self.seed * 1009 + walk * 101 + part) << 32)) for part in range(-(-steps // 64))]

    def embed(self, stream: np.ndarray, starts: np.ndarray, size: int, walk: int) -> np.ndarray:
        """The walk's output for the windows of `size` words at `starts`, one row each."""
        steps = 2 * size
        bits = self.walk_bits(walk, steps)
        pointer, end = starts.astype(np.int64), starts + size
        out = np.empty((steps, len(starts)), dtype=np.int32)
        for j in range(steps):
            token = np.where(pointer < end, stream[np.minimum(pointer, len(stream) - 1)], self.pad)
            out[j] = token
            pointer += ((bits[j >> 6][token] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        return out

    def _hash(self, out: np.ndarray, steps: np.ndarray, factors: np.ndarray) -> np.ndarray:
        return (out[steps].astype(np.uint64) * factors[:, None]).sum(axis=0, dtype=np.uint64)

    def _build(self, c: LengthClass, rng: np.random.Generator, target: float) -> None:
        """Adds keys until edited copies of the class's items are found at the target; without
        keys that do, the class is searched by pieces."""
        stream = np.concatenate([self.sequences[i] for i in c.items])
        starts = np.cumsum([0, *(len(self.sequences[i]) for i in c.items[:-1])])
        own = [self.embed(stream, starts, c.size, w) for w in range(WALKS)]
        (chosen, of), (fresh, of_fresh) = self._copies(c, rng), self._copies(c, rng)
        found, again = np.zeros(of.shape, dtype=bool), np.zeros(of_fresh.shape, dtype=bool)
        while len(c.keys) < MOST_KEYS and found.mean(axis=1).min() < target:
            walk = len(c.keys) % WALKS
            steps = np.sort(rng.choice(2 * c.size, size=min(SAMPLED, c.size), replace=False))
            factors = rng.integers(1, 1 << 63, size=len(steps), dtype=np.uint64) | np.uint64(1)
            keys = self._hash(own[walk], steps, factors)
            found |= keys[of] == self._hash(chosen[walk], steps, factors).reshape(of.shape)
            again |= keys[of_fresh] == self._hash(fresh[walk], steps, factors).reshape(of.shape)
            order = np.argsort(keys, kind="stable")
            c.keys.append((walk, steps, factors))
            c.tables.append((keys[order], np.array(c.items)[order]))
        c.recall = float(again.mean(axis=1).min())
        if c.recall < target:
            c.exact, c.recall, c.keys, c.tables = True, 1.0, [], []

    def _copies(self, c: LengthClass, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
        """Each walk's output for edited copies of every item, and which item of the class each
        is of: a row of copies with edits anywhere, a row with edits in the first third."""
        rounds = -(-256 // len(c.items))
        of = np.tile(np.arange(len(c.items)), (2, rounds))
        copies = []
        for share, row in zip((1, 1 / 3), of, strict=True):
            for n in row:
                s = self.sequences[c.items[n]]
                copies.append(self._edited(s, allowed(len(s), self.similarity), rng, c.size, share))
        places = np.cumsum([0, *(len(x) for x in copies[:-1])])
        edited = np.concatenate(copies)
        # A window starts at a word of the item.
        places = np.array([p + int(np.argmax(x > 0)) for p, x in zip(places, copies, strict=True)])
        return [self.embed(edited, places, c.size, w) for w in range(WALKS)], of

    def _edited(self, sequence: np.ndarray, edits: int, rng: np.random.Generator, size: int, share: float = 1) -> np.ndarray:
        out = sequence.tolist()
        for _ in range(edits):
            kind, at = rng.integers(3), int(rng.integers(max(1, math.ceil(share * len(out)))))
            if kind == 0:
                out[at : at + 1] = [0]
            elif kind == 1:
                out.insert(at, 0)
            elif len(out) > 2:
                del out[at : at + 1]
        return np.array(out + [0] * size, dtype=np.int32)

    def _pieces(self, items: list[int], rng: np.random.Generator) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By length of piece: factors, sorted hashes, and the item and place of each.

        Of allowed + 1 disjoint pieces an edit changes one at most, so a match keeps one."""
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i in items:
            n, parts = len(self.sequences[i]), allowed(len(self.sequences[i]), self.similarity) + 1
            by_length.setdefault(max(1, n // parts), []).extend((i, n * p // parts) for p in range(min(n, parts)))
        out = []
        for length, rows in sorted(by_length.items()):
            factors = rng.integers(1, 1 << 63, size=length, dtype=np.uint64) | np.uint64(1)
            of, at = np.array(rows, dtype=np.int64).T
            parts = np.array([self.sequences[i][p : p + length] for i, p in rows], dtype=np.uint64)
            hashes = (parts * factors).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            out.append((length, factors, hashes[order], of[order], at[order]))
        return out

    def distance(self, stream: np.ndarray, item: int, start: int, first: int = 0, last: int | None = None) -> tuple[int, int, int]:
        """Least edit distance of the item to a stretch of the stream near `start`; where it
        begins and ends. The stretch lies in the text from `first` to `last`."""
        s = self.sequences[item]
        k = allowed(len(s), self.similarity)
        lo, hi = max(first, start - k), min(len(stream) if last is None else last, start + len(s) + 2 * k)
        part = stream[lo:hi]
        n = len(part)
        steps = np.arange(n + 1)
        row, begin = np.zeros(n + 1, dtype=np.int64), steps.copy()
        for i, token in enumerate(s, 1):
            swap, drop = row[:-1] + (part != token), row + 1
            best = drop.copy()
            origin = begin.copy()
            take = swap <= best[1:]
            best[1:][take], origin[1:][take] = swap[take], begin[:-1][take]
            best[0], origin[0] = i, 0
            # Skipping words of the document costs one each: the least of best[j'] + j - j'.
            shifted = best - steps
            running = np.minimum.accumulate(shifted)
            source = np.maximum.accumulate(np.where(shifted == running, steps, 0))
            row, begin = running + steps, origin[source]
        end = int(row.argmin())
        return int(row[end]), lo + int(begin[end]), lo + end

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, distance) of the items that the texts hold."""
        get, gap = self.vocabulary.get, [0] * (self.longest * 2 + 2)
        ids: list[int] = []
        first, last = [], []
        for text in texts:
            first.append(len(ids))
            ids += [get(w, 0) for w in words(text)]
            last.append(len(ids))
            ids += gap
        stream = np.array(ids, dtype=np.int32)
        bounds = np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for piece in self.pieces:
            self._search(piece, stream, bounds, best)
        for c in self.classes:
            span = max(1, c.size - c.slack)
            if c.exact or len(stream) < span:
                continue
            known = c.holds[stream]
            total = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
            held = total[span:] - total[:-span]
            starts = np.flatnonzero((held >= c.needed) & known[: len(held)])
            for at in range(0, len(starts), 20_000):
                self._probe(c, stream, starts[at : at + 20_000], bounds, best)
        return [(t, i, s, e, d) for (t, i), (d, s, e) in sorted(best.items())]

    def _probe(self, c: LengthClass, stream: np.ndarray, starts: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], best: dict) -> None:
        outs = [self.embed(stream, starts, c.size, w) for w in range(WALKS)]
        near: dict[int, list[np.ndarray]] = {}
        for (walk, steps, factors), (table, items) in zip(c.keys, c.tables, strict=True):
            keys = self._hash(outs[walk], steps, factors)
            lo, hi = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
            hit = np.flatnonzero(hi > lo)
            for n in range(int((hi - lo)[hit].max(initial=0))):
                more = hit[hi[hit] - lo[hit] > n]
                which = items[lo[more] + n]
                for item in np.unique(which):
                    near.setdefault(int(item), []).append(starts[more[which == item]])
        for item, found in near.items():
            self._verify(stream, item, np.unique(np.concatenate(found)), bounds, best)

    def _search(self, piece: tuple, stream: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], best: dict) -> None:
        """Looks up the pieces of one length at every place of the stream."""
        length, factors, table, of, place = piece
        total = np.concatenate([[0], np.cumsum(stream > 0, dtype=np.int32)])
        starts = np.flatnonzero(total[length:] - total[:-length] == length)
        for n in range(0, len(starts), 20_000):
            part = starts[n : n + 20_000]
            hashes = (stream[part[:, None] + np.arange(length)].astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
            lo, hi = np.searchsorted(table, hashes, "left"), np.searchsorted(table, hashes, "right")
            hit = np.flatnonzero(hi > lo)
            counts = (hi - lo)[hit]
            row = np.repeat(lo[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            at = np.repeat(part[hit], counts)
            # Where the item would begin, if not before the text that holds the piece.
            begin = np.maximum(at - place[row], bounds[0][np.searchsorted(bounds[0], at, "right") - 1])
            order = np.lexsort((begin, of[row]))
            items, begin = of[row][order], begin[order]
            for item, first, count in zip(*(x.tolist() for x in np.unique(items, return_index=True, return_counts=True)), strict=True):
                self._verify(stream, item, np.unique(begin[first : first + count]), bounds, best)

    def _verify(self, stream: np.ndarray, item: int, starts: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], best: dict) -> None:
        """Puts into `best` where the item stands in the texts that hold the starts. The text is the start's, and
        nothing before or after it counts: swapping a missing word with a gap costs no more than dropping it."""
        first, last = bounds
        length, reached = len(self.sequences[item]), -1
        for start in self._plausible(stream, item, starts).tolist():
            if start < reached:
                continue
            text = int(np.searchsorted(first, start, "right")) - 1
            distance, begin, end = self.distance(stream, item, start, int(first[text]), int(last[text]))
            if distance <= allowed(length, self.similarity):
                # A start far off may have met only a part of the place: look again from where that begins.
                while (again := self.distance(stream, item, begin, int(first[text]), int(last[text])))[0] < distance:
                    distance, begin, end = again
                reached = end
                place = (distance, int(begin - first[text]), int(end - first[text]))
                if place < best.get((text, item), (1 << 30,)):
                    best[text, item] = place

    def _plausible(self, stream: np.ndarray, item: int, starts: np.ndarray) -> np.ndarray:
        """The starts whose surroundings hold enough of the item's distinct words: an edit
        takes away one of them at most, so this rules out no match."""
        s = self.sequences[item]
        k = allowed(len(s), self.similarity)
        distinct = np.unique(s)
        column = np.zeros(self.pad + 1, dtype=np.int64)
        column[distinct] = np.arange(1, len(distinct) + 1)
        offsets = np.arange(-k, len(s) + 2 * k)
        keep = []
        for at in range(0, len(starts), 5000):
            part = starts[at : at + 5000]
            around = column[stream[np.clip(part[:, None] + offsets, 0, len(stream) - 1)]]
            seen = np.zeros((len(part), len(distinct) + 1), dtype=bool)
            seen[np.arange(len(part))[:, None], around] = True
            keep.append(part[seen[:, 1:].sum(axis=1) >= len(distinct) - k])
        return np.concatenate(keep)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items, at most about `block_chars` characters at a time."""
    size = benchmark.agg(F.coalesce(F.sum(F.length(f"`{text}`")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_chars))
    for b in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(f"`{item_id}`", f"`{text}`"), F.lit(n)) == b) if n > 1 else benchmark
        rows = part.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).distinct().collect()
        yield sorted(((r.i, r.t) for r in rows), key=lambda x: (x[0] is not None, () if x[0] is None else (x[0],), x[1] or ""))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    similarity: float = 0.8, target_recall: float = 0.97, min_words: int = 5, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, similarity): what documents hold
    of the benchmark; a row for each document and item."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").cast("string").alias("__text"))
    item_kind = benchmark.schema[item_id].dataType
    item_type = to_arrow_type(item_kind)
    out = None
    for items in _blocks(benchmark, item_id, item_text, block_chars):
        index = spark.sparkContext.broadcast(Index(items, similarity, target_recall, min_words))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in in_slices(batches):
                found = held.scan(batch.column(1).to_pylist()) if held.ids else []
                lengths = [len(held.sequences[f[1]]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([held.ids[f[1]] for f in found], item_type),
                        pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.int32()),
                        pa.array([1 - f[4] / n for f, n in zip(found, lengths, strict=True)], pa.float64()),
                    ],
                    names=[id_col, "item_id", "start_word", "end_word", "distance", "similarity"],
                )

        schema = f"`{id_col}` {dict(source.dtypes)[id_col]}, {SCHEMA.format(item_kind.simpleString())}"
        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without those that hold a benchmark item.

    The rows pass through the scan once and those that hold nothing come out as they went
    in, so there is no join and ids need not be unique."""
    spark = docs.sparkSession
    item_id, item_text = options.pop("item_id", "item_id"), options.pop("item_text", "text")
    block_chars = options.pop("block_chars", BLOCK_CHARS)
    at = docs.columns.index(text)
    for items in _blocks(benchmark, item_id, item_text, block_chars):
        index = spark.sparkContext.broadcast(Index(items, **options))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in in_slices(batches):
                bad = {f[0] for f in held.scan(batch.column(at).to_pylist())} if held.ids else set()
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
