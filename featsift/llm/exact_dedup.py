"""Exact dedup of incoming documents against immutable snapshots.

A snapshot is a table of exact buckets (SHA-256 digest, rows, largest id, one text)
and, per shard of digests, a static binary-fuse filter over its digests.  Both are
written once and never changed.

An incoming batch is first grouped by digest on its own (combined before the
shuffle, so thousands of copies are one row).  Its distinct digests are screened by
the filters; the few that pass (true members, and one in 2^16 others) join the
exact buckets, where the texts are compared byte for byte.  Of equal texts the row
with the largest id stays.

Defined cases: null text counts as empty; a null doc_id counts as larger than any
other; repeated rows are copies of one another, and of rows with equal doc_id and
text all count as staying; empty input or an empty snapshot gives an empty result
or no members; clashing extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.llm.common import behind_index, body, given_id, probed, real_id, stored
from featsift.llm.peeling import mix, peelable, slots

SHARD_KEYS = 200_000
PROBE_ROWS = 500_000  # probes that meet one copy of a shard's filter, about
_FILTER = "shard int, n long, seed int, length int, firsts int, prints binary"
_FILTER_ARROW = pa.schema(
    [("shard", pa.int32()), ("n", pa.int64()), ("seed", pa.int32()), ("length", pa.int32()), ("firsts", pa.int32()), ("prints", pa.binary())]
)


def keys_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=">u8").astype(np.uint64)


def fuse_filter(keys: np.ndarray) -> dict:
    """Binary-fuse filter of distinct 64-bit keys with 16-bit prints: the three
    slots of a key xor to its print."""
    keys = np.unique(keys)
    seed, length, firsts, where, (order, own, ends) = peelable(keys)
    prints = np.zeros((firsts + 2) * length, dtype=np.uint16)
    mark = print_of(keys)
    start = [0, *ends[:-1].tolist()]
    for lo, hi in list(zip(start, ends.tolist()))[::-1]:  # a wave's own slots are free of one another
        k, s = order[lo:hi], own[lo:hi]
        rest = prints[where[:, k]]
        prints[s] = 0
        prints[s] = mark[k] ^ np.bitwise_xor.reduce(np.where(where[:, k] == s, np.uint16(0), rest), axis=0)
    return {"n": len(keys), "seed": seed, "length": length, "firsts": firsts, "prints": prints.tobytes()}


def print_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 9_999) >> np.uint64(48)).astype(np.uint16)


def maybe_member(row: dict, keys: np.ndarray) -> np.ndarray:
    if not row["n"]:
        return np.zeros(len(keys), dtype=bool)
    prints = np.frombuffer(row["prints"], dtype=np.uint16)
    where = slots(keys, row["seed"], row["length"], row["firsts"])
    return np.bitwise_xor.reduce(prints[where], axis=0) == print_of(keys)


def _build(key, table):
    row = fuse_filter(keys_of(table.column("digest").to_pylist()))
    return pa.Table.from_pylist([{"shard": key[0].as_py(), **row}], schema=_FILTER_ARROW)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, digests in probed(batches, dict):
        hit = maybe_member(row, keys_of(digests.column("digest").to_pylist()))
        yield digests.select(["digest"]).filter(pa.array(hit))


def digested(docs: DataFrame) -> DataFrame:
    """(d, digest): the id and the SHA-256 of every text."""
    return docs.select(real_id().alias("d"), F.unhex(F.sha2(body(), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


@dataclass
class Snapshot:
    buckets: DataFrame  # digest, n, last
    texts: DataFrame  # d, raw: the documents, to fetch the text of a bucket's last row
    filters: DataFrame
    shards: int


def snapshot(docs: DataFrame) -> Snapshot:
    """Write the buckets and filters of ``docs``."""
    buckets = stored(grouped(digested(docs)), "buckets")
    shards = max(8, -(-buckets.count() // SHARD_KEYS))
    filters = buckets.groupBy(shard_of(shards).alias("shard")).applyInArrow(_build, _FILTER)
    texts = docs.select(real_id().alias("d"), body().alias("raw"))
    return Snapshot(buckets, texts, stored(filters, "filters"), shards)


def members(batch: DataFrame, texts: DataFrame, snap: Snapshot) -> DataFrame:
    """``(digest, n, last)`` of the snapshot buckets that rows of ``batch(digest, n,
    last)`` equal: screened by the filters, then compared byte for byte.
    ``texts(d, raw)`` holds the batch's documents."""
    shard = shard_of(snap.shards).alias("shard")
    # The filters follow the snapshot, the probes the batch.
    salts = max(1, -(-batch.count() // (snap.shards * PROBE_ROWS)))
    dealt = behind_index(snap.filters, batch.select("digest", shard), salts, F.xxhash64(F.lit(1), "digest"))
    passed = dealt.mapInArrow(_screen, "digest binary")
    old = snap.buckets.join(passed, "digest")
    pairs = stored(batch.select("digest", F.col("last").alias("new")).join(old, "digest"), "positives")

    def text_of(rows: DataFrame, side: str) -> DataFrame:
        want = pairs.select("digest", F.col(side).alias("d"))
        # Planned as a merge whatever the size, so that its cost follows the input.
        # By id and digest, so that rows that share an id (or have none) do not all meet.
        own = rows.withColumn("digest", F.unhex(F.sha2("raw", 256)))
        got = own.join(want.hint("merge"), ["d", "digest"])
        return got.groupBy("digest").agg(F.min("raw").alias(f"raw_{side}"))

    same = text_of(texts, "new").join(text_of(snap.texts, "last"), "digest").where("raw_new = raw_last")
    return pairs.join(same.select("digest"), "digest").select("digest", "n", "last")


def dedup(incoming: DataFrame, snap: Snapshot | None, old: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``incoming``
    (and of ``old``, the snapshot's documents, where given)."""
    rows = digested(incoming)
    batch = stored(grouped(rows), "batch")
    whole = batch
    if snap is not None:
        texts = incoming.select(real_id().alias("d"), body().alias("raw"))
        met = members(batch, texts, snap)
        whole = batch.unionByName(met).groupBy("digest").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        if old is not None:
            # Buckets that no incoming text equals stay as they were.
            whole = whole.unionByName(snap.buckets.join(met, "digest", "left_anti"))
            rows = rows.unionByName(digested(old))
    out = rows.join(whole, "digest")
    return out.select(
        given_id("d").alias("doc_id"), given_id("last").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("d") == F.col("last")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def arrivals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (snapshot, incoming batch): the older half of the id range and the rest."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    return docs.where(old), docs.where(~old)


def dedup_table(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its older half becomes the snapshot, its newer
    half comes in against it."""
    old, new = arrivals(docs)
    return dedup(new, snapshot(old), old)
