"""Line dedup through a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space and lower-cased (A-Z).  Keys
of ``MIN_POINTS`` code points or more that several documents hold lose all their
lines except in the document with the smallest id.

1. Line keys become 128-bit hashes; one grouped aggregate (combined before the
   shuffle, so a line in every document costs one row per task) gives each distinct
   hash its row count and smallest document.
2. All distinct hashes are the index.  Each shard of it is one row: a minimal perfect
   hash (slots of a peeled key graph, ranked) and compact arrays of fingerprints,
   counts and smallest documents in rank order.
3. Documents probe the arrays with their line hashes, dealt by shard; every answer
   comes from the arrays.  Probes stream in batches behind the index row; a shard with
   many of them (the counts of its hashes tell) gives its row to several groups, so a
   line that every document holds is answered by many tasks.  No line text travels.
4. Each text gets back the set of hashes it loses and is rebuilt.

Defined cases: null or empty text is one empty line; rows with the same doc_id are
one document; rows with a null doc_id are one that sorts after all others (answers
return by id and text, so many such rows never form one group); empty input gives an empty
result; clashing extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsift.llm.common import behind_index, body, given_id, probed, real_id, stored
from featsift.llm.peeling import peelable, slots

MIN_POINTS = 10
SHARD_KEYS = 100_000  # keys of the index per shard, about
PROBE_ROWS = 500_000  # probes that meet one copy of a shard's index, at most about
LEAST_PROBES = 20_000  # ... and at least, so that few copies are made of little work
HOT_SHARDS = 100_000  # shards that hold over 1 / HOT_SHARDS of all probes: fewer than HOT_SHARDS

_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes methods: ASCII white space, A-Z only


def line_hash(line: bytes) -> bytes | None:
    """16 bytes for a line that counts, else None."""
    key = line_key(line)
    if len(key) < MIN_POINTS or len(key.translate(None, _CONTINUATION)) < MIN_POINTS:
        return None
    return xxhash.xxh3_128_digest(key)


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def line_hashes(text: pa.Array) -> pa.Array:
    """The distinct hashes of the lines that count, for each text."""
    out = []
    for x in text:
        found = {line_hash(line) for line in (x.as_py() or b"").split(b"\n")}
        found.discard(None)
        out.append(list(found))
    return pa.array(out, pa.list_(pa.binary()))


def halves(hashes: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(b"".join(hashes), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return packed[:, 0], packed[:, 1]


# ---------------------------------------------------------------- the index

_INDEX = "shard int, n long, seed int, length int, firsts int, used binary, fingerprints binary, counts binary, firsts_doc binary"
_INDEX_ARROW = pa.schema(
    [("shard", pa.int32()), ("n", pa.int64()), ("seed", pa.int32()), ("length", pa.int32()), ("firsts", pa.int32())]
    + [(c, pa.binary()) for c in ("used", "fingerprints", "counts", "firsts_doc")]
)


def build_shard(hashes: list[bytes], counts: np.ndarray, docs: np.ndarray) -> dict:
    """Minimal perfect hash over distinct hashes with arrays in its order."""
    place, finger = halves(hashes)
    key = place ^ finger
    seed, length, firsts, where, waves = peelable(key)
    used = assign(where, waves, (firsts + 2) * length)
    rank = np.cumsum(used >> 2) - 1
    order, own, _ = waves
    at = np.empty(len(key), dtype=np.int64)
    at[order] = rank[own]
    f, c, d = np.empty(len(key), "<u8"), np.empty(len(key), "<i8"), np.empty(len(key), "<i8")
    f[at], c[at], d[at] = finger, counts, docs
    return {
        "n": len(key), "seed": seed, "length": length, "firsts": firsts, "used": used.tobytes(),
        "fingerprints": f.tobytes(), "counts": c.tobytes(), "firsts_doc": d.tobytes(),
    }


def assign(where: np.ndarray, waves: tuple, size: int) -> np.ndarray:
    """A code for each slot: bit 2 where a key owns it, and in bits 0 and 1 a number
    such that a key's three numbers sum, mod 3, to which of its slots is its own."""
    order, own, ends = waves
    code = np.zeros(size, dtype=np.int8)
    start = [0, *ends[:-1].tolist()]
    for lo, hi in list(zip(start, ends.tolist()))[::-1]:  # a wave's own slots are free of one another
        k, s = order[lo:hi], own[lo:hi]
        which = np.argmax(where[:, k] == s, axis=0)
        code[s] = (which - np.where(where[:, k] == s, 0, code[where[:, k]]).sum(axis=0)) % 3
    code[own] |= 4
    return code


class Shard:
    """One row of the index, ready to be probed."""

    def __init__(self, row: dict):
        self.row, self.used = row, np.frombuffer(row["used"], dtype=np.int8)
        self.rank = np.cumsum(self.used >> 2) - 1
        self.finger = np.frombuffer(row["fingerprints"], dtype="<u8")
        self.counts = np.frombuffer(row["counts"], dtype="<i8")
        self.docs = np.frombuffer(row["firsts_doc"], dtype="<i8")

    def probe(self, hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(count, smallest document) of each hash; 0 and -1 where it is not indexed."""
        place, finger = halves(hashes)
        where = slots(place ^ finger, self.row["seed"], self.row["length"], self.row["firsts"])
        pick = (self.used[where] & 3).sum(axis=0) % 3
        at = self.rank[where[pick, np.arange(where.shape[1])]]
        at = np.clip(at, 0, len(self.finger) - 1)
        known = self.finger[at] == finger
        return np.where(known, self.counts[at], 0), np.where(known, self.docs[at], -1)


def _build(key, table):
    hashes = table.column("h").to_pylist()
    row = build_shard(hashes, table.column("n").to_numpy(), table.column("first").to_numpy())
    return pa.Table.from_pylist([{"shard": key[0].as_py(), **row}], schema=_INDEX_ARROW)


def line_index(lines: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """``(index, hot, shards, probes)`` of ``lines(d, h)``: d a document id, h a line hash;
    ``hot(shard, salts)``: the shards whose probes need more copies of their row than
    others, fewer than ``HOT_SHARDS``; ``probes``: rows of ``lines``."""
    held = stored(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")), "distinct-lines")
    n_keys, n_rows = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(8, -(-n_keys // SHARD_KEYS))
    index = held.groupBy(shard_of(shards).alias("shard")).applyInArrow(_build, _INDEX)
    return stored(index, "line-index"), stored(hot_shards(held, n_rows, shards), "hot-shards"), shards, n_rows


def shard_of(shards: int):
    return F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")


def group_rows(spark: SparkSession, n_rows: int) -> int:
    """Probes for one copy of an index row: a small part of what a task gets anyway."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(PROBE_ROWS, max(LEAST_PROBES, n_rows // (4 * tasks)))


def hot_shards(held: DataFrame, n_rows: int, shards: int) -> DataFrame:
    rows = group_rows(held.sparkSession, n_rows)
    probes = held.groupBy(shard_of(shards).alias("shard")).agg(F.sum("n").alias("probes"))
    hot = probes.where((F.col("probes") > F.lit(2 * max(rows, n_rows // shards))) & (F.col("probes") * HOT_SHARDS > F.lit(n_rows)))
    return hot.select("shard", F.ceil(F.col("probes") / F.lit(rows)).cast("int").alias("salts"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, probes in probed(batches, Shard):
        count, first = shard.probe(probes.column("h").to_pylist())
        lost = (count > 1) & (first < probes.column("d").to_numpy())
        yield probes.select(["d", "tag", "h"]).filter(pa.array(lost))


def lost_lines(docs: DataFrame) -> DataFrame:
    """``(d, tag, lost)``: the hashes of the lines that the texts of document d with the
    hash ``tag`` lose.  A line's fate hangs on d and h alone, so equal tags do no harm."""
    lines = docs.select(real_id().alias("d"), text_tag(), F.explode(line_hashes(body())).alias("h"))
    lines = stored(lines, "lines")
    index, hot, shards, n_rows = line_index(lines)
    salts = max(1, -(-n_rows // (shards * group_rows(docs.sparkSession, n_rows))))
    probes = lines.withColumn("shard", shard_of(shards))
    dealt = behind_index(index, probes, salts, F.xxhash64("d", "tag", "h"), hot)
    answers = dealt.mapInArrow(_probe, "d long, tag long, h binary")
    return answers.groupBy("d", "tag").agg(F.collect_set("h").alias("lost"))


def text_tag(column: str = "text"):
    return F.xxhash64(body(column)).alias("tag")


_REBUILT = T.StructType([
    T.StructField("text", T.BinaryType()), T.StructField("n_lines", T.LongType()),
    T.StructField("n_dropped", T.LongType()), T.StructField("sha256", T.StringType()),
])


@F.arrow_udf(_REBUILT)
def rebuilt(text: pa.Array, lost: pa.Array) -> pa.Array:
    texts, n_lines, n_dropped, digests = [], [], [], []
    for raw, gone in zip(text, lost):
        lines = (raw.as_py() or b"").split(b"\n")
        drop = set(gone.as_py() or ())
        kept = [x for x in lines if line_hash(x) not in drop] if drop else lines
        texts.append(b"\n".join(kept))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
        digests.append(hashlib.sha256(texts[-1]).hexdigest())
    arrays = [pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
    return pa.StructArray.from_arrays(arrays, names=_REBUILT.names)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped, kept_sha256 for each row."""
    lost = lost_lines(docs)
    rows = docs.select(real_id().alias("d"), text_tag(), body().alias("raw")).join(lost, ["d", "tag"], "left")
    r = rows.select("d", rebuilt("raw", "lost").alias("r"))
    return r.select(
        given_id("d").alias("doc_id"), F.col("r.text").cast("string").alias("text"),
        F.col("r.n_lines").alias("n_lines"), F.col("r.n_dropped").alias("n_dropped"), F.col("r.sha256").alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; other columns stay,
    ``n_chars`` (where there is one) follows the text."""
    lost = lost_lines(docs)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), real_id().alias("d"), text_tag())
    r = rows.join(lost, ["d", "tag"], "left").select("row", rebuilt(body("row.text"), "lost").alias("r"))
    text = F.when(F.col("row.text").isNotNull(), F.col("r.text").cast("string")).alias("text")
    new = {"text": text, "n_chars": F.char_length(F.col("r.text").cast("string")).cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")}
    return r.select(*[new[c] if c in new else F.col("row")[c].alias(c) for c in names])
