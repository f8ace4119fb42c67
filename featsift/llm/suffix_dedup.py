"""Removal of repeated substrings with enhanced suffix arrays of content-defined buckets.

A byte goes if it lies in a ``LENGTH``-byte string that also starts anywhere else.

1. Every window of ``LENGTH`` bytes is filed under the smallest hash of its
   ``GRAM``-byte grams.  Equal windows are filed alike; neighbouring windows mostly
   share the file, and a run of them is one segment of text.  Only hashes travel:
   (file, segment hash, place), about one row for each LENGTH / 2 bytes.
2. Equal segments are grouped first (combined before the shuffle): where there are
   two or more, all their windows repeat.  Thousands of copies end here.
3. In files that hold several different segments, one of each is fetched, and an
   enhanced suffix array (order and common-prefix lengths) of their windows is built
   per file.  A stack scan yields the tree of common-prefix intervals; an interval
   whose occurrences differ in the byte to the left is a maximal repeat group, with
   all its occurrences.  (Others only restate a group that starts one byte earlier.)
4. Files of more than ``FILE_ROWS`` different segments or ``FILE_BYTES`` are not held by
   one task and not gathered: their windows are hashed where the documents are, counted
   by a grouped aggregate, and repeated where the count is two or more.  A run of over
   ``SEGMENT_WINDOWS`` windows in one file (periodic text) is several segments.
5. The covered ranges of each document are joined and cut out.

Matches never cross documents.  Defined cases: null text is empty; texts under
``LENGTH`` bytes stay whole; rows are told apart by doc_id and text, and repeated rows
are repeats of each other; a null doc_id is an id of its own; empty input gives an
empty result; extra columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsift.llm.common import body, complete_groups, given_id, real_id, stored

LENGTH = 400
GRAM = 64  # a power of two
FILE_ROWS = 2048
FILE_BYTES = 1_500_000
SEGMENT_WINDOWS = 65_536
_CHUNK = 2_000_000  # bytes hashed at once
_BLOCK = 1_500_000  # bytes of files taken together for a suffix array


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place (by doubling)."""
    table = np.random.Generator(np.random.PCG64(3)).integers(0, 2**63, 256, dtype=np.uint64)
    h, width, factor = table[data], 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * np.uint64(factor) + h[width:]
            factor = factor * factor % 2**64
            width *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place: the powers of two that
    make up ``length``, each hashed by doubling and added one after the other."""
    table = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 256, dtype=np.uint64)
    n = len(data) - length + 1
    h, width, factor, done = table[data], 1, 0xC2B2AE3D27D4EB4F, 0
    total = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        while n > 0:
            if length & width:
                total = total * np.uint64(factor) + h[done:done + n]
                done += width
            if done == length:
                break
            h = h[:-width] * np.uint64(factor) + h[width:]
            factor = factor * factor % 2**64
            width *= 2
    return total


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` hashes from each place."""
    reach, low = 1, h
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, bool]]:
    """(text number, start, windows, file, whether the file's gram occurs twice in it)."""
    width = length - gram + 1
    sizes = np.array([len(t) for t in texts])
    if not (sizes >= length).any():
        return
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    h = gram_hashes(data, gram)
    low = window_minima(h, width)  # one for each window of the joined bytes
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    for number in np.flatnonzero(sizes >= length):
        first, n = begin[number], sizes[number] - length + 1
        mine = low[first:first + n]
        starts = np.r_[0, np.flatnonzero(mine[1:] != mine[:-1]) + 1]
        # A periodic text is one run however long: it is cut, in places of its own.
        if n > SEGMENT_WINDOWS:
            ends = np.r_[starts[1:], n]
            starts = np.concatenate([np.arange(s, e, SEGMENT_WINDOWS) for s, e in zip(starts.tolist(), ends.tolist())])
        for s, e in zip(starts.tolist(), np.r_[starts[1:], n].tolist()):
            value = mine[s]
            twice = np.count_nonzero(h[first + s:first + e + width - 1] == value) > 1
            yield int(number), s, e - s, int(value), bool(twice)


_RUNS = "file long, segment long, d long, t long, start int, windows int, twice boolean"


def _chunks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of pieces of a batch of about ``size`` bytes."""
    first, texts, held = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        texts.append(x.as_py() or b"")
        held += len(texts[-1])
        if held >= size:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, texts in _chunks(batch, 2, _CHUNK):
            rows = list(runs(texts, length))
            if not rows:
                continue
            digest = xxhash.xxh3_64_intdigest
            names = [digest(texts[i][s:s + n + length - 1]) for i, s, n, _, _ in rows]
            number, start, windows, file, twice = zip(*rows)
            row = first + np.array(number)
            unsigned = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    unsigned(file), unsigned(names), pa.array(d[row]), pa.array(t[row]),
                    pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(twice),
                ],
                names=["file", "segment", "d", "t", "start", "windows", "twice"],
            )


# ---------------------------------------------------------------- enhanced suffix array


def suffix_array(data: np.ndarray, end: np.ndarray, wanted: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``wanted`` places by the suffixes up to their segment's end, common
    prefix of each with the one before it).  ``reach``: the longest segment."""
    n = len(data)
    place = np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    padded = np.r_[data, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    left = end - place
    for k in range(7):  # seven bytes, then how many of them there are
        key |= np.where(left > k, padded[k:k + n], np.uint64(0)) << np.uint64(56 - 8 * k)
    key |= np.minimum(left, 7).astype(np.uint64)
    levels, width = [], 7
    ranks = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        levels.append((width, np.r_[ranks, 0].astype(np.int32)))
        if width >= reach:
            break
        follow = np.where(left > width, np.minimum(place + width, n), n)
        ranks = np.unique(ranks * (n + 1) + levels[-1][1][follow], return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    order = wanted[np.argsort(levels[-1][1][wanted], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    most = np.minimum(left[a], left[b])
    common = np.zeros(len(a), dtype=np.int64)
    for width, rank in reversed(levels):
        same = (rank[a] == rank[b]) & (common < most)
        common[same] += width
        common = np.minimum(common, most)
        a[same] = order[:-1][same] + common[same]
        b[same] = order[1:][same] + common[same]
        a, b = np.minimum(a, n), np.minimum(b, n)
    for _ in range(6):
        same = (common < most) & (padded[a] == padded[b])
        common[same] += 1
        a[same] += 1
        b[same] += 1
    return order, np.r_[0, common]


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (first, last, length) of one run, by a stack scan."""
    stack = [(0, least)]
    for i in range(1, len(common) + 1):
        height, lo = (int(common[i]), i - 1) if i < len(common) else (0, 0)
        while stack and stack[-1][1] > height:
            lo, tall = stack.pop()
            yield lo, i - 1, tall
        if not stack or stack[-1][1] < height:
            stack.append((lo, height))


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> tuple[list, np.ndarray]:
    """Groups (first, last, length) in ``order`` whose occurrences differ to the left,
    and for each place in order the length of its longest group (0: none).
    ``before``: what stands left of each place in order; negative values are unlike any.

    Intervals come inner ones first, so a place belongs to the first group that takes
    it: the places not yet taken are a stack, and each enters and leaves it once."""
    groups, best = [], np.zeros(len(order), dtype=np.int64)
    tied = np.r_[False, common[1:] >= least]
    starts = np.flatnonzero(~tied)
    ends = np.r_[starts[1:], len(order)]
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        if hi - lo == 2:
            if before[lo] != before[lo + 1] or before[lo] < 0:
                groups.append((lo, lo + 1, int(common[lo + 1])))
                best[lo:hi] = common[lo + 1]
        elif hi - lo > 2:
            mine = before[lo:hi]
            # How often the left neighbour changes up to each place: an interval is
            # diverse if it changes inside it.
            change = np.r_[0, np.cumsum((mine[1:] != mine[:-1]) | (mine[1:] < 0))].tolist()
            if change[-1] == 0:
                continue
            free, seen = [], 0
            for a, b, t in intervals(np.r_[0, common[lo + 1:hi]], least - 1):
                free.extend(range(seen, b + 1))
                seen = b + 1
                if t >= least and change[b] > change[a]:
                    groups.append((lo + a, lo + b, t))
                    k = bisect.bisect_left(free, a)
                    best[[lo + x for x in free[k:]]] = t
                    del free[k:]
    return groups, best


_FOUND = "d long, t long, start long, size long, array long, lo long, hi long"


def _found(n: int, **columns) -> pa.RecordBatch:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c) if columns.get(c) is not None else pa.nulls(n, pa.int64()) for c in names], names=names)


def _arrays(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Occurrences (d, t, start, size, array, lo = place in the array) and groups (size,
    array, lo, hi).  A file has at most ``limit`` segments of ``FILE_BYTES`` in all."""
    for _, table in complete_groups(batches, "file", limit, block=3000):
        file = table.column("file").to_numpy()
        starts = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
        texts = table.column("segment").to_pylist()
        sizes = np.array([len(x) for x in texts])
        total = np.r_[0, np.cumsum(sizes)]
        cuts, at = [0], 0
        for s in [*starts[1:].tolist(), len(file)]:  # whole files, about _BLOCK bytes each
            if total[s] - total[at] >= _BLOCK or s == len(file):
                cuts.append(s)
                at = s
        for lo, hi in zip(cuts, cuts[1:]):
            yield from _one_array(table.slice(lo, hi - lo), texts[lo:hi], sizes[lo:hi], length)


def _laid_out(texts: list[bytes], sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin of each text in the joined bytes, the bytes, and owner and place of all windows."""
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
    return begin, np.frombuffer(b"".join(texts), dtype=np.uint8), owner, begin[owner] + offset


def _one_array(table: pa.Table, texts: list[bytes], sizes: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    begin, data, owner, wanted = _laid_out(texts, sizes, table.column("windows").to_numpy())
    # A window without an equal one here is in no interval: only the others, and
    # the segments that hold them, enter the suffix array.
    hashed = window_hashes(data, length)[wanted]
    _, kind, count = np.unique(hashed, return_inverse=True, return_counts=True)
    shared = count[kind] > 1
    if not shared.any():
        return
    live = np.unique(owner[shared])
    at = wanted[shared] - begin[owner[shared]]
    owner = np.searchsorted(live, owner[shared])
    table, texts, sizes = table.take(pa.array(live)), [texts[i] for i in live], sizes[live]
    begin, data, _, _ = _laid_out(texts, sizes, np.zeros(len(texts), dtype=np.int64))
    wanted = begin[owner] + at
    end = np.repeat(begin + sizes, sizes)
    order, common = suffix_array(data, end, wanted, int(sizes.max()))
    whose = np.empty(len(data), dtype=np.int64)
    whose[wanted] = owner
    seg = whose[order]
    inner = order > begin[seg]
    before = np.where(inner, data[np.maximum(order - 1, 0)].astype(np.int64), -1 - seg)
    groups, best = maximal_repeats(order, common, before, length)
    hit = np.flatnonzero(best)
    if not len(hit):
        return
    name = xxhash.xxh3_64_intdigest(texts[0], seed=len(texts)) >> 1
    name = np.int64(name ^ (int(table.column("file")[0].as_py()) & (2**62 - 1)))
    d, t, start = table.column("d").to_numpy(), table.column("t").to_numpy(), table.column("start").to_numpy()
    s = seg[hit]
    yield _found(
        len(hit), d=pa.array(d[s]), t=pa.array(t[s]), start=pa.array(start[s] + order[hit] - begin[s]),
        size=pa.array(best[hit]), array=pa.array(np.full(len(hit), name)), lo=pa.array(hit.astype(np.int64)),
    )
    g = np.array(groups, dtype=np.int64).reshape(-1, 3)
    yield _found(
        len(g), size=pa.array(g[:, 2].copy()), array=pa.array(np.full(len(g), name)), lo=pa.array(g[:, 0].copy()), hi=pa.array(g[:, 1].copy())
    )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each document."""
    for batch in batches:
        columns = {c: [] for c in ("file", "d", "t", "start", "windows", "segment")}
        for d, t, raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            text = raw.as_py() or b""
            for w in wanted:
                for c, v in (("file", w["file"]), ("d", d), ("t", t), ("start", w["start"]), ("windows", w["windows"])):
                    columns[c].append(v)
                columns["segment"].append(text[w["start"]:w["start"] + w["windows"] + length - 1])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types)], names=list(columns))


_CUT = "file long, d long, t long, start int, windows int, segment binary"


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, d, t, start) of every window of the segments."""
    for batch in batches:
        digest = xxhash.xxh3_128_digest
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            n, text = row["windows"], row["segment"]
            hashes = [digest(text[k:k + length]) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes, pa.binary()), pa.array([row["d"]] * n, pa.int64()), pa.array([row["t"]] * n, pa.int64()),
                    pa.array(range(row["start"], row["start"] + n), pa.int64()),
                ],
                names=["h", "d", "t", "start"],
            )


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(real_id().alias("d"), F.xxhash64(body(), F.length(body())).alias("t"), body().alias("raw"))


def repeats(texts: DataFrame, length: int = LENGTH, limit: int = FILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``covers(d, t, start, size)``, what the suffix arrays found) of
    ``texts(d, t, raw)``."""
    occ = stored(texts.mapInArrow(lambda it: _segments(it, length), _RUNS), "runs")
    place = F.struct("d", "t", "start")
    distinct = occ.groupBy("file", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.first("windows").alias("windows"), F.max("twice").alias("twice")
    )
    distinct = stored(distinct, "segments")
    size = F.sum((F.col("windows") + F.lit(length)).cast("long")).alias("bytes")
    files = distinct.groupBy("file").agg(F.count(F.lit(1)).alias("kinds"), size, F.min("n").alias("least"), F.max("twice").alias("again"))
    # Where all segments have copies nothing is open; one alone matters if periodic.
    unsure = files.where((F.col("least") == 1) & ((F.col("kinds") > 1) | F.col("again")))
    unsure = stored(unsure.select("file", ((F.col("kinds") > limit) | (F.col("bytes") > FILE_BYTES)).alias("dense")), "files")

    def fetched(files: DataFrame) -> DataFrame:
        """The text of one copy of each segment of ``files``, on the tasks of its document."""
        wanted = distinct.join(files.select("file"), "file").select("file", "windows", "first.*")
        per_doc = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("file", "start", "windows")).alias("wanted"))
        # A row repeated under one id is fetched once for each copy; one is enough.
        return texts.join(per_doc, ["d", "t"]).select("d", "t", "raw", "wanted").mapInArrow(lambda it: _cut(it, length), _CUT)

    dealt = fetched(unsure.where("NOT dense")).repartition("file").sortWithinPartitions("file")
    found = stored(dealt.mapInArrow(lambda it: _arrays(it, length, limit), _FOUND), "repeats")
    whole = occ.join(distinct.where("n > 1").select("file", "segment"), ["file", "segment"])
    covers = whole.select("d", "t", F.col("start").cast("long").alias("start"), (F.col("windows") + F.lit(length - 1)).cast("long").alias("size"))
    covers = covers.unionByName(found.where("d IS NOT NULL").select("d", "t", "start", "size"))
    if not unsure.where("dense").isEmpty():
        segments = fetched(unsure.where("dense")).select("d", "t", "start", "windows", "segment")
        each = stored(segments.mapInArrow(lambda it: _windows(it, length), "h binary, d long, t long, start long"), "windows")
        again = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        covers = covers.unionByName(each.join(again, "h").select("d", "t", "start", F.lit(length).cast("long").alias("size")))
    return covers, found


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Maximal repeat groups inside files with all occurrences: array, lo, hi (the
    group), size, doc_id, start."""
    _, found = repeats(identified(docs), length)
    groups = found.where("hi IS NOT NULL").select("array", "lo", "hi", "size")
    spots = found.where("d IS NOT NULL").select("array", F.col("lo").alias("at"), "d", "start")
    met = groups.join(spots, "array").where(F.col("at").between(F.col("lo"), F.col("hi")))
    return met.select("array", "lo", "hi", "size", given_id("d").alias("doc_id"), "start")


_REST = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()), T.StructField("sha256", T.StringType()),
])


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return list(zip(starts[new].tolist(), ends[np.r_[new[1:] - 1, len(ends) - 1]].tolist()))


@F.arrow_udf(_REST)
def remaining(text: pa.Array, covers: pa.Array) -> pa.Array:
    rows = []
    for raw, found in zip(text, covers):
        data, gone = raw.as_py() or b"", []
        if found.is_valid and len(found.values):
            at = found.values
            starts = at.field("start").to_numpy(zero_copy_only=False)
            gone = spans(starts, starts + at.field("size").to_numpy(zero_copy_only=False))
        edges = [0, *[x for s in gone for x in s], len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        rows.append((len(data), len(data) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_REST.names)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 for each row."""
    texts = identified(docs)
    covers, _ = repeats(texts, length)
    per_doc = covers.groupBy("d", "t").agg(F.collect_set(F.struct("start", "size")).alias("covers"))
    r = texts.join(per_doc, ["d", "t"], "left").select("d", remaining("raw", "covers").alias("r"))
    return r.select(
        given_id("d").alias("doc_id"), "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept", F.col("r.sha256").alias("kept_sha256")
    )
