"""Sharding through fixed virtual slots and a versioned slot map.

Records are hashed into ``SLOTS`` slots for good; only the map from slots to shards
is ever edited.  Bytes are summed per slot (a fixed number of rows, so the map is
worked out on the driver whatever the corpus' size), the map is balanced by moving
few slots from the fullest shard to the emptiest, and each edit is stored as a new
version beside the old ones.

The law is ``bytes``: sizes of shards come near equal.  A record's slot follows from
its id and text, so copies under many ids spread over all slots.

Defined cases: null text has no bytes and CRC 0; a null doc_id is hashed like any
value; repeated rows share a slot and take places in turn; empty input gives an
empty result, and its map is the even one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsift.llm.common import body
from featsift.session import scratch_path

SLOTS = 4096
SHARDS = 8
MAP = "version int, vslot int, shard int"


def hashed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot for each row of ``docs``."""
    vslot = F.pmod(F.xxhash64("doc_id", body()), F.lit(slots)).cast("int")
    return docs.select(
        "doc_id", (F.length(body()) + 1).cast("long").alias("size"), F.crc32(body()).alias("text_crc32"), vslot.alias("vslot")
    )


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    sizes = [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect():  # one row per slot
        sizes[r.vslot] = r.b
    return sizes


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [v * shards // slots for v in range(slots)]


def rebalanced(old: list[int], sizes: list[int], shards: int) -> list[int]:
    """``old`` edited: slots leave shards above the mean, largest first, as long as
    they do not fall under it, and go to the emptiest; then single slots move or
    swap while that narrows the gap between the fullest and the emptiest shard.  A
    shard beyond the old map's starts empty, so growing is the same edit."""
    new, mean = list(old), sum(sizes) / shards
    held = [[] for _ in range(shards)]
    load = [0] * shards
    for v, s in enumerate(new):
        held[s].append(v)
        load[s] += sizes[v]
    spare: list[int] = []
    for s in range(shards):
        for v in sorted(held[s], key=lambda v: (-sizes[v], v)):
            if sizes[v] and load[s] - sizes[v] >= mean:
                load[s] -= sizes[v]
                spare.append(v)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for v in sorted(spare, key=lambda v: (-sizes[v], v)):
        b, s = heapq.heappop(heap)
        new[v] = s
        heapq.heappush(heap, (b + sizes[v], s))
    load = [0] * shards
    for v, s in enumerate(new):
        load[s] += sizes[v]
    for _ in range(4 * len(sizes)):
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        # Moving d bytes helps as long as 0 < d < gap; the best d is half the gap.
        mine = sorted((sizes[v], v) for v, s in enumerate(new) if s == hi and sizes[v])
        theirs = [(0, -1)] + sorted((sizes[v], v) for v, s in enumerate(new) if s == lo and sizes[v])
        best, j = None, 0
        for a, v in mine:
            while j + 1 < len(theirs) and a - theirs[j + 1][0] >= gap / 2:
                j += 1
            for b, u in theirs[max(0, j - 1):j + 2]:
                if 0 < a - b < gap and (best is None or abs(a - b - gap / 2) < best[0]):
                    best = (abs(a - b - gap / 2), a - b, v, u)
        if best is None:
            break
        _, d, v, u = best
        new[v] = lo
        if u >= 0:
            new[u] = hi
        load[hi] -= d
        load[lo] += d
    return new


def store_map(spark: SparkSession, path: str, version: int, mapping: list[int]) -> None:
    """Append one version; versions are never overwritten."""
    rows = [(version, v, s) for v, s in enumerate(mapping)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version:06d}").select("vslot", "shard")


def placed(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds shard and slot (the row's place in its shard, gapless from 0).

    A place is the rows of the shard's earlier virtual slots plus the place within
    the own one; each window holds one virtual slot, a fixed fraction of the rows.
    """
    counts = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(mapping), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    out = rows.withColumn("own", F.row_number().over(own) - 1).join(F.broadcast(starts), "vslot")
    return out.withColumn("slot", (F.col("start") + F.col("own")).cast("long")).drop("own", "start")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, map_version, shard, slot for each row.

    Version 1 of the map deals slots evenly; version 2 is version 1 rebalanced by
    bytes.  Both are stored under ``path`` (default: a folder of the shared
    checkpoint folder) and the placement reads the stored version.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "slot-map")
    rows = hashed(docs, slots)
    first = even_map(shards, slots)
    store_map(spark, path, 1, first)
    store_map(spark, path, 2, rebalanced(first, slot_bytes(rows, slots), shards))
    return placed(rows, load_map(spark, path, 2)).withColumn("map_version", F.lit(2))
