"""Operator 3, sharding by Karmarkar-Karp differencing.

Documents of equal text form a group that no shard boundary may cut; the groups go to
shards so that the bytes of the shards differ as little as possible. Differencing keeps
partial partitions, tuples of `shards` sums. It takes the two with the largest spread and
adds them oppositely ordered, the largest sum of one on the smallest of the other, until
one is left.

A heap of all groups doesn't fit one task, so the groups under a `grain`-th of all bytes
are bundled by their hash into at most `grain` lumps; the others, at most `grain` too, stay
items of their own. Differencing runs over these at most 2 * grain items, whatever the
input's size, on the driver. A small group never leaves its lump and a lump never its
shard, so no group is cut. The lumps differ in size, so the spread that is left is that of
differencing thousands of items: bytes, not lumps. Where there are fewer groups than
lumps, most groups are alone in theirs.

Slots number the rows of a shard without gaps: rows are counted by (shard, sub-bucket),
and a row's slot is the count of the sub-buckets before its own plus its rank in it.

Defined cases. Null text has size 1 and checksum 0 and forms one group with itself, apart
from the empty text only in the checksum of its group (both are no bytes, one group).
Repeated rows are rows: each has a slot of its own. An empty table gives an empty result.
Extra columns are kept unless they bear the name of a result column."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drumlin.llm.common import materialize

LAW = "bytes"
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def differencing(items: list[tuple[int, ...]]) -> tuple[list[list[int]], list[int]]:
    """Adds tuples of equally many sums until one is left.

    Returns, for each item, the bin of the result that each of its bins went to, and the
    result's sums, in ascending order. Ties go by position, so the outcome is fixed."""
    k = len(items[0])
    heap, made = [], []
    for i, sums in enumerate(items):
        order = sorted(range(k), key=lambda b: (sums[b], b))
        ordered = [sums[b] for b in order]
        made.append((None, None, order))
        heap.append((ordered[0] - ordered[-1], i, ordered))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(k), key=sums.__getitem__)
        ordered = [sums[x] for x in order]
        made.append((i, j, order))
        heapq.heappush(heap, (ordered[0] - ordered[-1], len(made) - 1, ordered))
    # Downwards: place[node][rank] is the final bin of the node's rank-th smallest sum.
    place: list[list[int] | None] = [None] * len(made)
    place[-1] = list(range(k))
    out: list[list[int]] = [[] for _ in items]
    for node in range(len(made) - 1, -1, -1):
        i, j, order = made[node]
        own = place[node]
        place[node] = None
        before = [0] * k  # the unsorted bin of each rank
        for rank, x in enumerate(order):
            before[x] = own[rank]
        if i is None:
            out[node] = before
        else:
            place[i], place[j] = before, before[::-1]
    return out, heap[0][2]


def _sizes(text: str) -> dict[str, Column]:
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return {"size": (F.octet_length(value) + 1).cast("long"), "text_crc32": F.crc32(value)}


def assign_groups(groups: DataFrame, shards: int, grain: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Two tables of at most `grain` rows each: (item, shard) for the large groups and
    (lump, shard) for the others, from groups (item string, bytes long)."""
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = groups.where(F.col("bytes") * grain >= total)
    lumps = groups.where(F.col("bytes") * grain < total).groupBy(lump_of("item", grain).alias("lump")).agg(F.sum("bytes").alias("bytes"))
    items = [(r.item, None, r.bytes) for r in large.collect()] + [(None, r.lump, r.bytes) for r in lumps.collect()]
    items.sort(key=lambda x: (x[2], x[0] or "", x[1] or 0))
    bins = differencing([(*[0] * (shards - 1), x[2]) for x in items])[0] if items else []
    placed = [(*x[:2], b[-1]) for x, b in zip(items, bins, strict=True)]
    spark = groups.sparkSession
    return (
        spark.createDataFrame([(item, shard) for item, _, shard in placed if item is not None], "item string, shard int"),
        spark.createDataFrame([(lump, shard) for item, lump, shard in placed if item is None], "lump long, shard int"),
    )


def lump_of(item: str, grain: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(grain)).cast("long")


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text: str = "text", grain: int = 4096, rows_per_bucket: int = 20_000) -> DataFrame:
    """`docs` with size, text_crc32, law, shard, slot and grown_shard; the text goes.

    A group is known by the SHA-256 of its text. grown_shard is null: under this law one
    more shard means a new balance, not a move of few rows."""
    kept = [c for c in docs.columns if c.lower() not in (*ADDED, text.lower())]
    own = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own")  # extra columns meet no name used here
    rows = docs.select(own, F.col(f"`{id_col}`").alias("id"), *(c.alias(k) for k, c in _sizes(text).items()), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256).alias("item"))
    rows = materialize(rows, "sized")
    groups = materialize(rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    large, lumps = assign_groups(groups.select("item", "bytes"), shards, grain)
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-n // rows_per_bucket))
    bucket = F.pmod(F.xxhash64("id", "text_crc32", "size", F.spark_partition_id()), F.lit(buckets))
    dealt = rows.withColumns({"bucket": bucket, "lump": lump_of("item", grain)})
    dealt = dealt.join(F.broadcast(large.withColumnRenamed("shard", "large")), "item", "left")
    dealt = dealt.join(F.broadcast(lumps.withColumnRenamed("shard", "small")), "lump", "left")
    placed = materialize(dealt.withColumn("shard", F.coalesce("large", "small")).drop("lump", "large", "small"), "placed")
    counts = placed.groupBy("shard", "bucket").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select("shard", "bucket", "before")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "item"))
    return placed.withColumn("rank", rank).join(before, ["shard", "bucket"]).select(
        *(F.col(f"own.`{c}`") for c in kept), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
