"""Shards of near-equal bytes by longest-processing-time scheduling.

Rows with equal texts are one group and stay together. Groups go, the largest first, to the shard with the
least load, taken from a heap. The heap runs on the driver over the distinct sizes, not over groups: B bytes have
fewer than sqrt(2 B) distinct sizes (250,000 for 30 GB, 14 million for 100 TB). A size of more than CHUNK groups is
cut into chunks of about that many. A run of equal sizes is dealt out in closed form, with the same counts that the heap
gives one by one. Groups find their shard by their rank in the chunk; all that touches groups or rows is distributed.

Defined results: a null text counts as empty with 0 bytes and shares the group of the empty text. Equal rows
get slots of their own. A null doc_id is a value like others. Other columns are ignored; an empty table gives
no rows. A group larger than a shard's share leaves its shard heavier than the rest, as groups are not cut.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import text_key, write_shared

SHARDS, ROW_BYTES, CHUNK, SLOT_ROWS = 40, 16, 10_000, 50_000


def deal(loads: list[tuple[float, int]], size: float, n: int) -> list[int]:
    """Give n items of one size to the shards in the heap loads; how many each shard got."""
    got = [0] * len(loads)
    if n > 8 * len(loads):
        order = sorted(loads, key=lambda x: x[1])
        base = np.array([x[0] for x in order])
        low, high = base.min(), base.max() + size * n
        for _ in range(80):  # the level below which n places or fewer lie
            level = (low + high) / 2
            if np.maximum(0, np.ceil((level - base) / size)).sum() <= n:
                low = level
            else:
                high = level
        many = np.maximum(0, np.ceil((low - base) / size)).astype(int)
        got = many.tolist()
        loads[:] = [(b + size * k, x[1]) for b, k, x in zip(base.tolist(), got, order, strict=True)]
        heapq.heapify(loads)
        n -= sum(got)
    for _ in range(n):
        load, k = loads[0]
        got[k] += 1
        heapq.heapreplace(loads, (load + size, k))
    return got


def schedule(classes: Iterable[tuple[int, int, int]], shards: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """For (size, chunk, groups) from the largest size: size, chunk, the shards that get groups and the ranks at which their parts end."""
    loads = [(0.0, k) for k in range(shards)]
    for size, chunk, n in classes:
        got = np.array(deal(loads, float(size), n))
        yield size, chunk, np.flatnonzero(got).tolist(), np.cumsum(got[got > 0]).tolist()


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text_key(F.col("text")).alias("tid")
    )
    rows = write_shared(rows, "rows")
    groups = write_shared(rows.groupBy("tid").agg(F.sum("size").alias("bytes")), "groups")
    wide = write_shared(groups.groupBy("bytes").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")), "sizes")
    dealt = groups.join(wide, "bytes").withColumn("chunk", F.pmod(F.xxhash64("tid"), F.col("chunks")))
    place = Window.partitionBy("bytes", "chunk").orderBy("tid")
    dealt = write_shared(dealt.select("tid", "bytes", "chunk", (F.row_number().over(place) - 1).alias("rank")), "ranks")
    sizes = dealt.groupBy("bytes", "chunk").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes"), "chunk")
    plan = list(schedule(((r.bytes, r.chunk, r.n) for r in sizes.collect()), n))
    plan = spark.createDataFrame(plan, "bytes bigint, chunk bigint, shards array<int>, ends array<int>")
    where = dealt.join(plan, ["bytes", "chunk"]).select("tid", F.expr("element_at(shards, size(filter(ends, e -> e <= rank)) + 1)").alias("shard"))
    placed = rows.join(where, "tid")
    parts = max(1, math.ceil(rows.count() / SLOT_ROWS))
    placed = write_shared(placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "tid"), F.lit(parts))), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "tid")
    slots = placed.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["shard", "part"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("start") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
