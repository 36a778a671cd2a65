"""Operator 6, SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are split into groups of correlated bits. If two fingerprints
differ in at most `radius` bits and the groups' thresholds sum to radius - groups + 1,
some group differs in at most its threshold. The thresholds are unequal and come from
dynamic programming over estimated candidate counts; a group with threshold -1 is never
probed. Every fingerprint is filed under its value in each group with threshold 0 or more
and probes the values within the threshold; members of a bucket are verified on all bits.

Only distinct fingerprints are compared, so copies cost one row. A bucket leaves a spanning
forest of its links, not its pairs. A bucket over `bucket_limit` fingerprints goes another
exact way. Up to a radius of two each member is filed under all fingerprints within one bit
of it, and two are within two bits of each other exactly when they share such a neighbour; a
neighbour has 65 members at most, so no key of that step grows with the data. For larger
radii the bucket is cut into blocks of `bucket_limit`, and every two blocks are compared in
a task of their own.

A wide radius brings strangers together by chance, the more the larger the corpus. With
`second` a second fingerprint, of other hashes, has to be within that many bits too.

Defined cases. Null or empty text has fingerprint zero and links like any other. Repeated
rows share their component. A null doc_id is never the smallest; a component of null ids
has a null id. An empty table gives an empty result. Extra columns are dropped by
simhash_components() and kept by drop_near_duplicates(), whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drumlin.llm.common import free_name, in_slices, materialize
from drumlin.llm.components import connected_components

BITS = 64
SEED = 42
HOT_KEYS_LIMIT = 100_000
#: What an estimated candidate costs, where a filed row costs 1: a few machine instructions.
CANDIDATE_COST = 0.002


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of one text: a bit is set if over half the shingle hashes set it."""
    return fingerprints_of(text, shingle)[0]


def fingerprints_of(text: str | None, shingle: int = 3, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """One fingerprint for each seed of the shingles' hash."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z changes, only ASCII white space splits
    if not words:
        return [0] * len(seeds)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if len(words) <= shingle:
        shingles = [joined]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends + 1 - sizes)[:n].tolist()
        shingles = [joined[i:j] for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    out, digest = [], xxhash.xxh64_intdigest
    for seed in seeds:
        total = np.zeros(BITS, dtype=np.int64)
        values = np.array([digest(x, seed) for x in shingles], dtype=np.uint64)
        for part in range(0, n, 100_000):
            total += np.unpackbits(values[part : part + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little"))
    return out


def with_fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 3, keep: list[str] | None = None, second: bool = False) -> DataFrame:
    """The columns `keep` and the fingerprint as a signed long, `fp`; a second one in `fp2`,
    or the same there."""
    keep = list(keep or [])
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("fp", "long").add("fp2", "long")
    seeds = (SEED, SEED + 1) if second else (SEED,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            values = np.array([fingerprints_of(t, shingle, seeds) for t in texts], dtype=np.uint64).view(np.int64).reshape(len(texts), len(seeds))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values[:, 0]), pa.array(values[:, -1])], names=[*keep, "fp", "fp2"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(free_name(docs, "__text_of_fp"))).mapInArrow(run, schema)


# Planning: groups of bits and their thresholds


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many set both.

    Each partition gives one 64 x 64 table; the tables are summed by Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for frame in frames:
            raw = np.ascontiguousarray(frame["fp"].to_numpy(dtype=np.int64)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(frame)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    cells = fps.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(BITS * BITS + 1, dtype=np.int64)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return int(table[-1]), table[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Groups of bits of near equal size; correlated bits come into one group.

    What a bit tells of another then falls inside one group, and the groups' matches are as
    independent of each other as the data allow. Greedy: a group starts at the free bit with
    the strongest free partner and takes the free bit most correlated with its members."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = (BITS - sum(map(len, out))) // (groups - g)
        pool = sorted(free)
        first = max(pool, key=lambda b: (max((corr[b, c] for c in pool if c != b), default=0), -b))
        own = [first]
        free.remove(first)
        while len(own) < size:
            best = max(sorted(free), key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def estimate_costs(n: int, both: np.ndarray, groups: list[list[int]], radius: int, collisions: list[float]) -> np.ndarray:
    """cost[group, t + 1]: rows to file plus the cost of the estimated candidates at threshold t.
    Values that differ in d of a group's w bits share C(w - d, t - d) of its buckets.

    The chance that two fingerprints differ in at most t bits of a group follows from the
    bits' marginals; the observed number of exact collisions corrects it for correlation."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    cost = np.zeros((len(groups), radius + 2))
    for g, bits in enumerate(groups):
        chance = np.zeros(radius + 1)
        chance[0] = 1
        for b in bits:
            chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
            chance[0] *= 1 - differ[b]
        equal = chance[0] * n * n / 2
        factor = max(1.0, collisions[g] / max(equal, 1e-9)) if n else 1.0
        w = len(bits)
        for t in range(radius + 1):
            met = sum(chance[d] * math.comb(w - d, t - d) for d in range(min(t, w) + 1)) if t <= w else math.inf
            cost[g, t + 1] = n * math.comb(w, t) + CANDIDATE_COST * min(met * n * n / 2 * factor, math.comb(w, t) * n * n / 2) if t <= w else math.inf
    return cost


def allocate(cost: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """Thresholds of -1 or more that sum to `budget` at the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                candidate = (c + row[t + 1], [*chosen, t])
                if spent + t not in step or candidate < step[spent + t]:
                    step[spent + t] = candidate
        best = step
    return best[budget]


def group_value(fp: Column, bits: list[int]) -> Column:
    """The group's bits, the others zero: a mask keeps what a shift and a gather would."""
    return fp.bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def plan_groups(fps: DataFrame, radius: int, group_counts: tuple[int, ...] = ()) -> tuple[list[list[int]], list[int]]:
    """The grouping and thresholds with the least estimated cost."""
    n, both = bit_statistics(fps)
    group_counts = group_counts or ((2, 3, 4) if radius <= 2 else tuple(range(max(2, radius // 2), min(radius, 8) + 1)))
    plans = {m: group_bits(n, both, m) for m in group_counts}
    keys = [(m, g, bits) for m, groups in plans.items() for g, bits in enumerate(groups)]
    filed = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), group_value(F.col("fp"), bits).alias("v")) for k, (_, _, bits) in enumerate(keys)))).alias("x")).select("x.*")
    seen = dict(filed.groupBy("k", "v").count().where("count > 1").groupBy("k").agg(F.sum(F.expr("count * (count - 1) / 2"))).collect())
    found = []
    for m, groups in plans.items():
        collisions = [float(seen.get(k, 0)) for k, (of, _, _) in enumerate(keys) if of == m]
        cost, thresholds = allocate(estimate_costs(n, both, groups, radius, collisions), radius - m + 1)
        found.append((cost, m, groups, thresholds))
    return min(found)[2:]


def bucket_masks(bits: list[int], threshold: int) -> list[int]:
    """Which bits of a group count in each of its bucket tables: all but `threshold` of them.
    Two values are in a common bucket exactly if they differ in `threshold` bits at most."""
    whole = sum(1 << b for b in bits)
    return [signed(whole ^ sum(1 << b for b in left)) for left in combinations(bits, threshold)]


def bucket_links(fps: np.ndarray, radius: int, others: np.ndarray | None = None, second: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among one bucket's fingerprints, as pairs of their places.

    `others` are the second fingerprints, which have to be within `second` bits."""
    free, out = np.arange(len(fps)), []
    order = np.argsort(fps, kind="stable")
    free = free[order]
    while len(free):
        reached, free = free[:1], free[1:]
        while len(reached) and len(free):
            nxt = []
            for x in reached:
                near = np.bitwise_count(fps[free] ^ fps[x]) <= radius
                if others is not None:
                    near &= np.bitwise_count(others[free] ^ others[x]) <= second
                if near.any():
                    out += [(int(x), int(y)) for y in free[near]]
                    nxt.append(free[near])
                    free = free[~near]
            reached = np.concatenate(nxt) if nxt else free[:0]
    return out


def has_partner(fps: np.ndarray, radius: int, others: np.ndarray | None = None, second: int = 0, block: int = 256) -> np.ndarray:
    """Which fingerprints of a bucket are linked to another one: most are strangers to all."""
    out = np.zeros(len(fps), dtype=bool)
    for at in range(0, len(fps), block):
        near = np.bitwise_count(fps[at : at + block, None] ^ fps) <= radius
        if others is not None and near.sum() > len(near):
            near &= np.bitwise_count(others[at : at + block, None] ^ others) <= second
        out[at : at + block] = near.sum(axis=1) > 1
    return out


def node_of(fp: str, fp2: str) -> Column:
    """A pair of fingerprints as one long: the first where both are one."""
    return F.when(F.col(fp) == F.col(fp2), F.col(fp)).otherwise(F.xxhash64(fp, fp2))


def near_links(fps: DataFrame, radius: int = 2, bucket_limit: int = 2000, second: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`: the components they span are those of
    all pairs within `radius` bits. With `second` nodes are pairs of fingerprints `fp`, `fp2`,
    named by node_of(), and those within `radius` and `second` bits are linked."""
    groups, thresholds = plan_groups(fps, radius)
    active = [(g, bits, t) for g, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    tables = [(g << 16 | k, mask) for g, bits, t in active for k, mask in enumerate(bucket_masks(bits, t))]
    rows = F.array(*(F.struct(F.lit(k).alias("g"), F.lit(mask).alias("mask")) for k, mask in tables))
    filed = fps.select("fp", "fp2", F.explode(rows).alias("x")).select("fp", "fp2", "x.g", F.col("fp").bitwiseAND(F.col("x.mask")).alias("v"))
    hot_keys = materialize(filed.groupBy("g", "v").agg(F.count("*").alias("n")).where(F.col("n") > bucket_limit), "hot")
    n_hot = hot_keys.count()
    marked = F.broadcast(hot_keys) if n_hot <= HOT_KEYS_LIMIT else hot_keys
    cold = filed.join(marked, ["g", "v"], "left_anti") if n_hot else filed
    member = F.struct("fp", "fp2") if second is not None else F.col("fp")
    buckets = cold.groupBy("g", "v").agg(F.collect_list(member).alias("fps")).where(F.size("fps") > 1).select("fps")
    if n_hot and radius > 2:
        # Every two blocks of a hot bucket meet in a group of their own.
        blocks = F.ceil(F.col("n") / bucket_limit).cast("int")
        hot = filed.join(marked, ["g", "v"]).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("fp", "fp2"), blocks).cast("int")})
        met = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy("g", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        buckets = buckets.union(met.agg(F.collect_list(member).alias("fps")).where(F.size("fps") > 1).select("fps"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            column = batch.column(0)
            flat, offsets = column.flatten(), column.offsets.to_numpy()
            parts = flat.flatten() if second is not None else [flat]
            first, *rest = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in parts)
            other = rest[0] if rest else None
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]
            near = np.bitwise_count(first[two] ^ first[two + 1]) <= radius
            if other is not None:
                near &= np.bitwise_count(other[two] ^ other[two + 1]) <= second
            found.append(np.stack([two[near], two[near] + 1], axis=1))
            for i in np.flatnonzero(sizes > 2):
                at, end = offsets[i], offsets[i + 1]
                own, own2 = first[at:end], None if other is None else other[at:end]
                met = np.flatnonzero(has_partner(own, radius, own2, second or 0))
                if len(met):
                    links = bucket_links(own[met], radius, None if own2 is None else own2[met], second or 0)
                    found.append(met[np.array(links, dtype=np.int64)] + at)
            at = np.concatenate(found)
            columns = [pa.array(x[at[:, side]].view(np.int64)) for side in (0, 1) for x in (first, first if other is None else other)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "a2", "b", "b2"])

    links = buckets.mapInArrow(verify, "a long, a2 long, b long, b2 long")
    links = links.select("a", "b") if second is None else links.select(node_of("a", "a2").alias("a"), node_of("b", "b2").alias("b"))
    if not n_hot or radius > 2:
        return links
    hot = filed.join(marked, ["g", "v"], "left_semi").select("fp").distinct()
    balls = hot.select("fp", F.explode(F.array(F.lit(0), *(F.lit(signed(1 << b)) for b in range(BITS)))).alias("flip"))
    shared = balls.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if radius == 2:
        exact = shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    else:
        exact = shared.where(F.expr("array_contains(fps, centre)")).select(F.col("centre").alias("a"), F.explode("fps").alias("b")).where("a <> b")
        exact = exact.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return links.union(exact)


def components_of(fingerprints: DataFrame, *, id_col: str, radius: int = 2, bucket_limit: int = 2000, second: int | None = None) -> DataFrame:
    """(node, component, component_id) for every distinct fingerprint, or pair of them; the id
    is the smallest of all documents that chains of links reach."""
    least = F.min(F.col(f"`{id_col}`")).alias("least")
    distinct = materialize(fingerprints.groupBy("fp", "fp2").agg(least).withColumn("node", node_of("fp", "fp2") if second is not None else F.col("fp")), "fingerprints")
    parts = connected_components(near_links(distinct.select("fp", "fp2"), radius, bucket_limit, second))
    labelled = distinct.select("node", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "labelled")
    # Minima pre-aggregate, and the table of them stands alone, so Spark may split the
    # rows of a large component in the join.
    least = materialize(labelled.groupBy("component").agg(F.min("least").alias("chain_least")), "least")
    return labelled.join(least, "component").select("node", "component", F.col("chain_least").alias("component_id"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, bucket_limit: int = 2000) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = materialize(with_fingerprints(slim, shingle=shingle, keep=["id"]), "simhash")
    parts = components_of(prints, id_col="id", radius=radius, bucket_limit=bucket_limit)
    return prints.withColumnRenamed("fp", "node").join(parts, "node").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 10, second: int | None = 16, bucket_limit: int = 2000) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id; of repeated
    rows of it, one.

    Rows are known by their id and two hashes of their text, so ids need not be unique. A
    radius of 10 in 64 bits is about where shingles have a Jaccard similarity of 0.8."""
    h1, h2, n = (free_name(docs, x) for x in ("__text_hash", "__text_hash2", "__row"))
    keyed = docs.withColumns({h1: F.xxhash64(f"`{text}`"), h2: F.hash(f"`{text}`")})
    slim = keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.col(f"`{text}`").alias("text"))
    prints = materialize(with_fingerprints(slim, shingle=shingle, keep=["id", "h1", "h2"], second=second is not None), "simhash")
    parts = components_of(prints, id_col="id", radius=radius, bucket_limit=bucket_limit, second=second)
    nodes = prints.select("id", "h1", "h2", (node_of("fp", "fp2") if second is not None else F.col("fp")).alias("node"))
    joined = nodes.join(parts, "node").where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = joined.groupBy("component").agg(F.min(F.struct("id", "h1", "h2")).alias("first"))
    k = {c: free_name(keyed, f"__kept_{c}") for c in ("id", "h1", "h2")}
    kept = kept.select(*(F.col(f"first.{c}").alias(name) for c, name in k.items()))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(k["id"])) & (F.col(h1) == F.col(k["h1"])) & (F.col(h2) == F.col(k["h2"]))
    rows = keyed.join(kept, same, "left_semi")
    repeated = prints.groupBy("id", "h1", "h2").count().where("count > 1")
    if repeated.isEmpty():
        return rows.drop(h1, h2)
    from pyspark.sql import Window

    return rows.withColumn(n, F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), h1, h2).orderBy(F.lit(1)))).where(F.col(n) == 1).drop(h1, h2, n)
