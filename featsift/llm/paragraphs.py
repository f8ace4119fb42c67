"""Paragraph near-dedup by MinHash banding with exact verification.

A paragraph is a line of a text (split at line feeds).  It is compared by the set of
its five-word shingles (A-Z lower-cased); one of one to four words has its whole word
sequence as its only shingle, so its copies link.  Two link at a Jaccard similarity
of ``THRESHOLD`` or more.

1. Equal word sequences collapse into one distinct paragraph by a 128-bit hash, so
   copies, however many, are one row from here on.
2. ``tune_bands`` picks the number of bands that finds a pair at the threshold with
   probability ``RECALL`` or more; a distinct paragraph has one hash per band.
3. Rows sorted by band hash stream through the tasks; colliding paragraphs leave as
   members of a bucket.  Buckets with the same members are handled once.
4. Members fetch their shingles; inside a bucket exact Jaccard is computed and
   only links that span the bucket's components leave the task.  Buckets over
   ``BUCKET_ROWS`` members or ``BUCKET_BYTES`` of shingles are dealt to pairs of blocks,
   which covers every pair.
5. Links form components; in each the first paragraph (smallest document, then
   place) stays and the others are removals.

Defined cases: null text has no paragraphs, nor are wordless lines any; a null doc_id sorts last; rows with the
same doc_id, or none, are told apart by their text alone; repeated rows are copies; empty
input gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsift.llm.common import block_pairs, body, complete_groups, given_id, real_id, stored
from featsift.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
BAND_ROWS = 3
BUCKET_ROWS = 5_000
BUCKET_BYTES = 32 << 20  # of shingles, eight bytes each
BATCH_SHINGLES = 1 << 20  # hashed or handed on at a time (one paragraph may have more)


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """The least number of bands of ``rows`` hashes that a pair at ``threshold``
    shares one of with probability ``recall``."""
    miss, bands = 1.0, 0
    while 1.0 - miss < recall:
        miss *= 1.0 - threshold**rows
        bands += 1
    return bands


def shingles(line: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the line's shingles."""
    words = line.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))  # a short line is one shingle
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter(map(digest, map(b" ".join, zip(*(words[k:] for k in range(size))))), dtype=np.uint64))


def band_hashes(sets: list[np.ndarray], bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """(n, bands) hashes: each of ``rows`` minima over the set, mixed together."""
    flat = np.concatenate(sets)
    at = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    rng = np.random.Generator(np.random.PCG64(7))
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(bands * rows):
            h = flat * factor[i] + shift[i]
            low = np.minimum.reduceat(h ^ (h >> np.uint64(31)), at)
            band = i // rows
            out[:, band] = (out[:, band] ^ low) * np.uint64(0x9FB21C651E98DF25) + np.uint64(band + 1)
            out[:, band] ^= out[:, band] >> np.uint64(28)
    return out


_LINES = "d long, place int, tag long, p binary, bands array<long>"


def signed(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    """(d, place, tag, p, bands) of every paragraph that has a shingle; p: its hash."""
    rows, sets, n = [], [], 0

    def out() -> pa.RecordBatch:
        hashed = band_hashes(sets, bands).view(np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(hashed.ravel()), bands).cast(pa.list_(pa.int64()))
        docs, places, tags, names = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(tags, pa.int64()), pa.array(names, pa.binary()), lists],
            names=["d", "place", "tag", "p", "bands"],
        )

    for batch in batches:
        for d, raw, tag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            for place, line in enumerate((raw.as_py() or b"").split(b"\n")):
                grams = shingles(line)
                if len(grams):
                    rows.append((d, place, tag, name_of(line)))
                    sets.append(grams)
                    n += len(grams)
                    if n >= BATCH_SHINGLES or len(rows) >= 20_000:
                        yield out()
                        rows, sets, n = [], [], 0
    if rows:
        yield out()


def name_of(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(line.lower().split()))


_MEMBERS = "bucket long, n long, p binary"


def _collide(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Members of bands that two or more paragraphs share, named by their member set;
    a band over ``limit`` keeps its band hash as name and leaves with n = -1."""
    for whole, table in complete_groups(batches, "band", limit):
        band = table.column("band").to_numpy()
        p = table.column("p").combine_chunks()
        if not whole:
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.full(len(band), -1)), p], names=["bucket", "n", "p"])
            continue
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        sizes = np.diff(np.r_[starts, len(band)])
        many = sizes > 1
        member = np.flatnonzero(np.repeat(many, sizes))
        if not len(member):
            continue
        got = p.take(pa.array(member))
        names = np.frombuffer(b"".join(got.to_pylist()), dtype="<u8").reshape(-1, 2)
        at = np.r_[0, np.cumsum(sizes[many])[:-1]]
        with np.errstate(over="ignore"):
            mixed = (names[:, 0] ^ (names[:, 0] >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + names[:, 1]
            mixed ^= mixed >> np.uint64(29)
            bucket = np.add.reduceat(mixed, at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(bucket, sizes[many]).view(np.int64)), pa.array(np.repeat(sizes[many], sizes[many]).astype(np.int64)), got],
            names=["bucket", "n", "p"],
        )


def spanning(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Index pairs at Jaccard ``threshold`` or more that span the components."""
    if len(sets) == 2:
        inter = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return [(0, 1)] if inter >= threshold * (len(sets[0]) + len(sets[1]) - inter) else []
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    mine = [codes[e - n:e] for e, n in zip(ends, sizes)]
    mark = np.zeros(codes.max() + 1, dtype=bool)
    owner = np.repeat(np.arange(len(sets)), sizes)
    left, found = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            mark[mine[x]] = True
            inter = np.bincount(owner[mark[codes]], minlength=len(sets))[left]
            mark[mine[x]] = False
            near = inter >= threshold * (sizes[left] + sizes[x] - inter)
            found += [(int(x), int(y)) for y in left[near]]
            queue.extend(left[near])
            left = left[~near]
            if near.any():  # reached paragraphs need no more counting
                keep = np.isin(owner, left)
                codes, owner = codes[keep], owner[keep]
    return found


_FOUND = "a binary, b binary, heavy long, weight long"


def _verify(batches: Iterator[pa.RecordBatch], key: str, threshold: float, limit_bytes: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) inside the groups; a group over ``limit_bytes`` leaves member by member
    as (a, null, its key, number of shingles)."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("heavy", pa.int64()), ("weight", pa.int64())])
    for whole, table in complete_groups(batches, key, 2**62, block=20_000, block_bytes=BUCKET_BYTES, limit_bytes=limit_bytes):
        keys = table.column(key).to_numpy()
        lists = table.column("grams").combine_chunks()
        cuts = lists.offsets.to_numpy()
        if not whole:
            p = table.column("p").combine_chunks()
            yield pa.RecordBatch.from_arrays([p, pa.nulls(len(p), pa.binary()), pa.array(keys), pa.array(np.diff(cuts).astype(np.int64))], schema=schema)
            continue
        p = table.column("p").to_pylist()
        flat = lists.values.to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        a, b = [], []
        for lo, hi in zip(starts, np.r_[starts[1:], len(keys)]):
            sets = [flat[cuts[i]:cuts[i + 1]] for i in range(lo, hi)]
            for i, j in spanning(sets, threshold) if hi - lo > 1 else ():
                a.append(p[lo + i])
                b.append(p[lo + j])
        if a:
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), none, none], schema=schema)


_GRAMS = "p binary, grams array<long>"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the wanted lines of a document."""

    def out(names: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["p", "grams"]
        )

    names, sets, n = [], [], 0
    for batch in batches:
        for raw, places in zip(batch.column(0), batch.column(1).to_pylist()):
            lines = (raw.as_py() or b"").split(b"\n")
            for place in places:
                names.append(name_of(lines[place]))
                sets.append(shingles(lines[place]).view(np.int64))
                n += len(sets[-1])
                if n >= BATCH_SHINGLES:
                    yield out(names, sets)
                    names, sets, n = [], [], 0
    if names:
        yield out(names, sets)


def paragraph_links(
    lines: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, limit: int = BUCKET_ROWS, limit_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``(a, b)`` between distinct paragraphs; they span every component of the graph
    of all colliding pairs at ``threshold``.  ``lines``: p, bands, first (d, place, tag);
    ``texts(d, raw, tag)``, the tag a hash of the text."""
    rows = lines.select("p", F.posexplode("bands").alias("i", "h")).select(F.xxhash64("i", "h").alias("band"), "p")
    sorted_rows = rows.repartition("band").sortWithinPartitions("band")
    met = stored(sorted_rows.mapInArrow(lambda it: _collide(it, limit), _MEMBERS), "collisions")
    members = stored(met.distinct(), "members")
    wanted = lines.join(members.select("p").distinct(), "p").select("p", "first.d", "first.tag", "first.place")
    places = wanted.groupBy("d", "tag").agg(F.collect_list("place").alias("places"))
    # Rows that repeat a document as it is bring the same lines again: one of each stays.
    grams = texts.join(places, ["d", "tag"]).select("raw", "places").mapInArrow(_grams, _GRAMS)
    grams = stored(grams.dropDuplicates(["p"]), "grams")

    def links(rows: DataFrame, key: str, most: int) -> DataFrame:
        dealt = rows.select(key, "p", "grams").repartition(key).sortWithinPartitions(key)
        return dealt.mapInArrow(lambda it: _verify(it, key, threshold, most), _FOUND)

    found = stored(links(members.where("n > 1").join(grams, "p"), "bucket", limit_bytes), "bucket-links")
    dense = members.where("n = -1").select("bucket", "p")
    heavy = found.where("heavy IS NOT NULL").select(F.col("heavy").alias("bucket"), F.col("a").alias("p"), "weight")
    found = found.where("heavy IS NULL").select("a", "b")
    if not (dense.isEmpty() and heavy.isEmpty()):
        weighed = dense.join(grams.select("p", F.size("grams").cast("long").alias("weight")), "p").unionByName(heavy)
        pairs = block_pairs(weighed, "bucket", "p", max(limit // 2, 1), "weight", max(limit_bytes // 16, 1))
        found = found.unionByName(links(pairs.join(grams, "p"), "pair", 2**62).select("a", "b"))
    return stored(found.distinct(), "paragraph-links")


def near_paragraphs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each paragraph that has a near or exact copy: doc_id, paragraph
    (its line, from 0), component_id (smallest doc_id of the component), n_paragraphs
    (of the component), removed (all but the first)."""
    bands = tune_bands(threshold, recall)
    texts = docs.select(real_id().alias("d"), body().alias("raw"), F.xxhash64(body()).alias("tag"))
    rows = texts.mapInArrow(lambda it: signed(it, bands), _LINES)
    place = F.struct("d", "place", "tag")
    lines = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.first("bands").alias("bands"))
    lines = stored(lines, "paragraphs")
    links = paragraph_links(lines, texts, threshold)
    root = components(links).withColumnRenamed("node", "p")
    rooted = lines.select("p", "n", "first").join(root, "p", "left").withColumn("root", F.coalesce("root", "p"))
    groups = rooted.groupBy("root").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    named = stored(rooted.select("p", "root").join(groups, "root").select("p", F.col("n").alias("n_paragraphs"), "first"), "classes")
    where = docs.select(real_id().alias("d"), F.posexplode(paragraph_names(body())).alias("place", "p"))
    out = where.where(F.col("p").isNotNull()).join(named, "p")
    return out.select(
        given_id("d").alias("doc_id"), F.col("place").alias("paragraph"), given_id("first.d").alias("component_id"),
        "n_paragraphs", ((F.col("d") != F.col("first.d")) | (F.col("place") != F.col("first.place"))).alias("removed"),
    )


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def paragraph_names(text: pa.Array) -> pa.Array:
    """The hash of every line, null where it has no word."""
    rows = ([name_of(x) if x.split() else None for x in (raw.as_py() or b"").split(b"\n")] for raw in text)
    return pa.array(list(rows), pa.list_(pa.binary()))
