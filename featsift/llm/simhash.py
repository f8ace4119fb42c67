"""SimHash near-dedup by a grid over per-segment bit counts.

A text's fingerprint has a bit for each bit position that is set in over half of
its shingles' hashes.  Fingerprints link at ``MAX_BITS`` or fewer differing bits;
linked ones form components.

Candidate search: a fingerprint's 32 two-bit segments become their bit counts (0 to
2).  The Manhattan distance of two count vectors is at most the Hamming distance,
and with the vector cut into ``MAX_BITS // 2 + 1`` parts, some part of two linked
vectors is at distance 0 or 1.  A part's count vector is a grid cell: each
fingerprint stands in its own cell of every part and visits the cells one step up in
one count, so linked fingerprints always meet in a cell, at least one of them at
home.  Within a cell the full Hamming distance is checked.

Equal fingerprints are one grid point, so copies cost nothing.  Cells stream through
sorted partitions; of a dense cell only a spanning tree of its links leaves the
task, never all pairs.  Cells over ``CELL_ROWS`` points are not held by one task:
they are dealt to pairs of blocks (``common.block_pairs``), which covers every pair.

Defined cases: null and wordless texts have fingerprint zero and link like any
other; a null doc_id counts as larger than any other; repeated rows share a
component; empty input gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsift.llm.common import block_pairs, body, complete_groups, fresh, given_id, real_id, stored
from featsift.llm.components import components

SHINGLE = 3
MAX_BITS = 3
HASH_SEED = 42
CELL_ROWS = 20_000
SMALL_CELL = 24

_SEGMENTS = 32
_LOW = np.uint64(0x5555555555555555)  # the low bit of every two-bit segment


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_digest
    packed = b"".join([digest(g, HASH_SEED) for g in grams])
    n = len(packed) // 8
    ones = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(packed, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):  # bounded memory for texts of any length
        ones += np.unpackbits(rows[at:at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


@F.arrow_udf(T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([_signed(fingerprint(x.as_py() or b"")) for x in text], pa.int64())


def bit_counts(prints: np.ndarray) -> np.ndarray:
    """The bit counts of the two-bit segments, each in its segment's two bits."""
    return (prints & _LOW) + ((prints >> np.uint64(1)) & _LOW)


def grid_cells(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """(cell, print, home) rows: the own cell in each part and one step up in one count."""
    parts = max_bits // 2 + 1
    cuts = [_SEGMENTS * p // parts for p in range(parts + 1)]
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        counts = bit_counts(prints)
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            mask = np.uint64(((1 << 2 * (hi - lo)) - 1) << 2 * lo)
            home = counts & mask
            cells, points, at_home = [home], [prints], [np.ones(len(prints), dtype=bool)]
            for segment in range(lo, hi):
                step = np.uint64(1 << 2 * segment)
                up = (counts >> np.uint64(2 * segment)) & np.uint64(3) < 2
                cells.append(home[up] + step)
                points.append(prints[up])
                at_home.append(np.zeros(int(up.sum()), dtype=bool))
            cell = np.concatenate(cells)
            # Cells of different parts are told apart by mixing in the part.
            with np.errstate(over="ignore"):
                cell = (cell ^ (cell >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + np.uint64(part * 0xA0761D6478BD642F % 2**64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.view(np.int64)), pa.array(np.concatenate(points).view(np.int64)), pa.array(np.concatenate(at_home))],
                names=["cell", "print", "home"],
            )


def tree_links(points: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links that span the components of ``points``: breadth first, each point
    compared once with all those not yet reached."""
    left = np.unique(points)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                for y in left[near]:
                    yield int(x), int(y)
                queue.extend(left[near])
                left = left[~near]


def links_in(cells: np.ndarray, points: np.ndarray, home: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of every run of equal ``cells``."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, dtype=int)
    sizes = np.diff(np.r_[starts, len(cells)])
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    at = np.flatnonzero(small)
    step = 1
    while len(at):  # all pairs of small cells, one distance in the sorted rows at a time
        at = at[at + step < len(cells)]
        at = at[cells[at + step] == cells[at]]
        near = np.bitwise_count(points[at] ^ points[at + step]) <= max_bits
        if home is not None:
            near &= home[at] | home[at + step]
        a.append(points[at[near]])
        b.append(points[at[near] + step])
        step += 1
    for i in np.flatnonzero(sizes > SMALL_CELL):
        found = list(tree_links(points[starts[i]:starts[i] + sizes[i]], max_bits))
        if found:
            pair = np.array(found, dtype=np.uint64)
            a.append(pair[:, 0])
            b.append(pair[:, 1])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


_MET = "a long, b long, cell long"  # cell is set for rows of a cell that passes through


def _meet(batches: Iterator[pa.RecordBatch], max_bits: int, limit: int) -> Iterator[pa.RecordBatch]:
    for whole, table in complete_groups(batches, "cell", limit):
        cell = table.column("cell").to_numpy()
        point = table.column("print").to_numpy()
        if whole:
            a, b = links_in(cell, point.view(np.uint64), table.column("home").to_numpy(), max_bits)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]].view(np.int64)
            columns = [pa.array(pairs[0].copy()), pa.array(pairs[1].copy()), pa.nulls(pairs.shape[1], pa.int64())]
        else:
            columns = [pa.array(point), pa.array(point), pa.array(cell)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "cell"])


def print_links(prints: DataFrame, max_bits: int = MAX_BITS, limit: int = CELL_ROWS) -> DataFrame:
    """``(a, b)``: links between distinct ``prints(fp)`` that span every component of
    the graph of all links."""
    if not 0 <= max_bits <= 2 * _SEGMENTS:
        raise ValueError("max_bits must lie between 0 and 64")
    cells = prints.select("fp").mapInArrow(lambda it: grid_cells(it, max_bits), "cell long, print long, home boolean")
    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell")
    met = stored(sorted_cells.mapInArrow(lambda it: _meet(it, max_bits, limit), _MET), "met")
    links = met.where("cell IS NULL").select("a", "b")
    dense = met.where("cell IS NOT NULL")
    if not dense.isEmpty():
        pairs = block_pairs(dense.select("cell", F.col("a").alias("print")), "cell", "print", limit // 2)

        def block(table: pa.Table) -> pa.Table:
            found = np.array(list(tree_links(table.column("print").to_numpy().view(np.uint64), max_bits)), dtype=np.uint64)
            found = found.reshape(-1, 2).view(np.int64)
            return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

        links = links.unionByName(pairs.groupBy("pair").applyInArrow(block, "a long, b long"))
    return links


def _prints(shingle: int):
    if shingle == SHINGLE:
        return fingerprints
    return F.arrow_udf(lambda t: pa.array([_signed(fingerprint(x.as_py() or b"", shingle)) for x in t], pa.int64()), T.LongType())


def _rooted(rows: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, root, component)`` of each distinct print of ``rows(d, fp)``: a print that
    names the component, and the component's smallest d."""
    points = stored(rows.groupBy("fp").agg(F.min("d").alias("first")), "points")
    root = components(print_links(points, max_bits)).withColumnRenamed("node", "fp")
    rooted = points.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.join(ids, "root").select("fp", "root", "component")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs``."""
    rows = stored(docs.select(real_id().alias("d"), _prints(shingle)(body()).alias("fp")), "prints")
    out = rows.join(_rooted(rows, max_bits).drop("root"), "fp")
    return out.select(
        given_id("d").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        given_id("component").alias("component_id"),
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest doc_id (of rows
    with this same id, the one that hashes lowest)."""
    name = fresh(docs, "row")
    key = ["d", "tag", "tag2"]  # equal rows share it; two hashes, as null ids may be many
    tags = F.xxhash64(name).alias("tag"), F.xxhash64(F.lit(1), name).alias("tag2")
    keyed = docs.select(F.struct(*docs.columns).alias(name)).select(name, real_id(f"{name}.doc_id").alias("d"), *tags)
    rows = stored(keyed.select(*key, _prints(shingle)(body(f"{name}.text")).alias("fp")), "prints")
    kinds = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"))
    least = kinds.join(_rooted(rows, max_bits), "fp").groupBy("root").agg(F.min(F.struct(*key, "n")).alias("k"))
    least = stored(least.select("k.*"), "kept")
    lone = keyed.join(least.where("n = 1"), key).select(name)
    # Of a row that is there several times one copy stays.
    one = keyed.join(least.where("n > 1"), key).groupBy(*key).agg(F.first(name).alias(name)).select(name)
    return lone.unionByName(one).select(f"{name}.*")
