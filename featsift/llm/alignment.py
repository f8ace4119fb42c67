"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

Both tokenizers cut the same bytes (a space and the text).  Where tokens of both end at
one byte offset there is a cut; the tokens between two cuts are a group, and all pairs
of tokens in a group are links.

A byte range's tokens (those that end in it) make a fragment: an open prefix up to its
first cut, closed groups, an open suffix behind its last cut; or, without a cut, open
tokens only.  Fragments of neighbouring ranges compose: the left suffix and the right
prefix close one group.  Composition is associative, so the fragments of a text of many
ranges of ``CHUNK`` bytes are rows, reduced in trees by groups of ``FAN`` on all tasks;
closed groups stay where they were closed, only open parts travel.  A shorter text is
one fragment behind the empty one that starts a text with a cut.

Links are kept per document as distinct id pairs with their numbers.  A pair's count,
the documents that hold it, is a grouped count over all documents (combined before the
shuffle); documents then meet the counts again, by broadcast as long as there are at
most ``FEW_PAIRS`` of them, else by a join dealt by pair and salt.

Both tokenizers are applied to pieces cut before a space that follows a sign that is
not white space: neither has a token across that place.  Distinct pieces are encoded
once in a task.

Defined cases: null, empty, and texts whose token bytes differ from the input (the
second tokenizer writes U+2581 as a space) have no tokens: zeros and an empty digest;
null and repeated doc_ids are rows of their own, each a document of the counts; empty
input gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featsift.llm.common import neighbours, stored

CHUNK = 32_768  # bytes of a fragment
FAN = 8
FEW_PAIRS = 8_000_000
SALTS = 16
REMEMBERED = 400_000  # pieces remembered by a task
_AT_ONCE = 5_000  # pieces encoded in one call
_CHARS = 4_000_000  # text tokenized in one go
_SPREAD = 4_000_000  # links written out at once
_SHIFT = 15  # a pair is (first id << 15) | second id

_NONE = np.zeros(0, dtype=np.int64)


# ---------------------------------------------------------------- the monoid


class Groups(NamedTuple):
    """Closed groups: both sides' ids, and how many of them each group has."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray

    def then(self, other: Groups) -> Groups:
        return Groups(*(np.concatenate(x) for x in zip(self, other)))


NO_GROUPS = Groups(_NONE, _NONE, _NONE, _NONE)


class Fragment(NamedTuple):
    cut: bool
    prefix: tuple[np.ndarray, np.ndarray]  # up to the first cut; all, if there is none
    closed: Groups
    suffix: tuple[np.ndarray, np.ndarray]  # behind the last cut


EMPTY = Fragment(False, (_NONE, _NONE), NO_GROUPS, (_NONE, _NONE))
BEGIN = Fragment(True, (_NONE, _NONE), NO_GROUPS, (_NONE, _NONE))


def fragment(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> Fragment:
    """The fragment of tokens with these ids and end offsets."""
    if not len(b):
        return Fragment(False, (a, b), NO_GROUPS, (_NONE, _NONE))
    at = np.searchsorted(b_end, a_end)
    same = b_end[np.minimum(at, len(b) - 1)] == a_end
    i, j = np.flatnonzero(same) + 1, at[same] + 1  # tokens up to each cut
    if not len(i):
        return Fragment(False, (a, b), NO_GROUPS, (_NONE, _NONE))
    closed = Groups(a[i[0]:i[-1]], np.diff(i), b[j[0]:j[-1]], np.diff(j))
    return Fragment(True, (a[:i[0]], b[:j[0]]), closed, (a[i[-1]:], b[j[-1]:]))


def _both(x: tuple, y: tuple) -> tuple:
    return tuple(np.concatenate(z) for z in zip(x, y))


def one_group(tokens: tuple[np.ndarray, np.ndarray]) -> Groups:
    if not len(tokens[0]) + len(tokens[1]):
        return NO_GROUPS
    return Groups(tokens[0], np.array([len(tokens[0])]), tokens[1], np.array([len(tokens[1])]))


def compose(f: Fragment, g: Fragment) -> Fragment:
    if not f.cut:
        return Fragment(g.cut, _both(f.prefix, g.prefix), g.closed, g.suffix)
    if not g.cut:
        return Fragment(True, f.prefix, f.closed, _both(f.suffix, g.prefix))
    return Fragment(True, f.prefix, f.closed.then(one_group(_both(f.suffix, g.prefix))).then(g.closed), g.suffix)


# ---------------------------------------------------------------- what groups yield

_COMMA, _BAR, _SEMICOLON = (np.array([f"{i}{sign}" for i in range(1 << 16)], dtype=object) for sign in ",|;")


def spelled(groups: Groups) -> str:
    """``a1,a2|b1;a3|b2`` of the groups."""
    a, n_a, b, n_b = groups
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    place_a = np.arange(len(a)) + np.repeat(before_b, n_a)
    place_b = np.arange(len(b)) + np.repeat(before_a + n_a, n_b)
    out = np.empty(len(a) + len(b), dtype=object)
    out[place_a], out[place_b] = _COMMA[a], _COMMA[b]
    last_a, last_b = before_a + n_a - 1, before_b + n_b - 1
    out[place_a[last_a]], out[place_b[last_b]] = _BAR[a[last_a]], _SEMICOLON[b[last_b]]
    return "".join(out.tolist())[:-1]


def _spread(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The pairs of all links of some groups."""
    width = np.repeat(n_b, n_a)  # of each first token
    start = np.repeat(np.cumsum(n_b) - n_b, n_a)
    nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return np.repeat(a, width) << _SHIFT | b[np.repeat(start, width) + nth]


def _counted(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    distinct, which, n = np.unique(pairs, return_inverse=True, return_counts=True)
    return (distinct, n) if times is None else (distinct, np.bincount(which, weights=times).astype(np.int64))


def linked(groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the groups' links, ascending, and how often each is linked."""
    a, n_a, b, n_b = groups
    if np.dot(n_a, n_b) <= _SPREAD:
        return _counted(_spread(a, n_a, b, n_b))
    # Groups in turn; a very large one by its distinct ids on both sides.
    found, held = [], []
    end_a, end_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
    i = j = 0
    for x, y in zip(end_a, end_b):
        p, q = a[i:x], b[j:y]
        i, j = x, y
        if len(p) * len(q) <= _SPREAD // 8:
            held.append(_counted(_spread(p, np.array([len(p)]), q, np.array([len(q)]))))
        else:
            (p, m), (q, n) = np.unique(p, return_counts=True), np.unique(q, return_counts=True)
            held.append(((p[:, None] << _SHIFT | q).ravel(), (m[:, None] * n).ravel()))
        if sum(len(h[0]) for h in held) > _SPREAD:
            found, held = [_counted(*(np.concatenate(z) for z in zip(*found, *held)))], []
    return _counted(*(np.concatenate(z) for z in zip(*found, *held)))


# ---------------------------------------------------------------- tokens


def _byte_level() -> dict[str, int]:
    """The signs that byte-level vocabularies write bytes with: printable Latin-1 signs
    stand for themselves, the others for code points from 256 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Two:
    """Both tokenizers over pieces of text, which one task remembers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = _byte_level()
        vocabulary = self.a.get_vocab()
        self.size_a = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.size_a[i] = len(token) if all(c in byte for c in token) else 0
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.blank = self.b.piece_to_id("▁")
        self.after_space, self.pieces_of = re.compile(r"\s ").search, re.compile(r"(?<=\S)(?= )").split
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids_a, self.at_a, self.ids_b, self.at_b = _NONE, np.zeros(1, dtype=np.int64), _NONE, np.zeros(1, dtype=np.int64)
        self.same = np.zeros(0, dtype=bool)

    def split(self, text: str) -> list[str]:
        text = " " + text
        return self.pieces_of(text) if self.after_space(text) else [" " + x for x in text.split(" ")[1:]]

    def learn(self, pieces: list[str]) -> None:
        # Joined pieces keep apart if each ends with a sign that is not white space.
        pieces = sorted(pieces, key=lambda p: p[-1].isspace())
        for lo in range(0, len(pieces), _AT_ONCE):
            part = pieces[lo:lo + _AT_ONCE]
            if part[-1][-1].isspace():
                found = [x.ids for x in self.a.encode_batch_fast(part, add_special_tokens=False)]
                counts = [len(x) for x in found]
                ids_a = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=sum(counts))
            else:
                ids_a = np.array(self.a.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids)
                ends = np.cumsum([len(p.encode()) for p in part])
                counts = np.diff(np.searchsorted(np.cumsum(self.size_a[ids_a]), ends) + 1, prepend=0)
            found = self.b.encode([p[1:] for p in part], num_threads=1)
            found = [x if p != " " else [self.blank] for p, x in zip(part, found)]
            counts_b = [len(x) for x in found]
            ids_b = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=sum(counts_b))
            raw = self.bytes_b.__getitem__
            if b"".join(map(raw, ids_b.tolist())) == "".join(part).encode():
                same = np.ones(len(part), dtype=bool)
            else:
                same = np.array([b"".join(map(raw, x)) == p.encode() for p, x in zip(part, found)])
            self.number |= dict(zip(part, range(len(self.number), len(self.number) + len(part))))
            self.ids_a, self.at_a = np.r_[self.ids_a, ids_a], np.r_[self.at_a, self.at_a[-1] + np.cumsum(counts)]
            self.ids_b, self.at_b = np.r_[self.ids_b, ids_b], np.r_[self.at_b, self.at_b[-1] + np.cumsum(counts_b)]
            self.same = np.r_[self.same, same]

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """(ids, end offsets) of both sides for each text; None for one without tokens."""
        if len(self.number) > REMEMBERED:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        self.learn([p for p in set().union(*split) if p not in self.number])
        for pieces in split:
            which = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            if not len(which) or not self.same[which].all():
                yield None
                continue
            a, b = self.ids_a[_rows(self.at_a, which)], self.ids_b[_rows(self.at_b, which)]
            yield a, np.cumsum(self.size_a[a]), b, np.cumsum(self.size_b[b])


def _rows(at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of lists ``which`` of a flat column with offsets ``at``."""
    n = at[which + 1] - at[which]
    return np.arange(n.sum()) + np.repeat(at[which] - (np.cumsum(n) - n), n)


# ---------------------------------------------------------------- Spark

# Whole texts have no chunk; a longer text is a row for each of its chunks.
_PARTS = (
    "row long, doc_id long, chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, digest string, "
    "pairs array<int>, times array<int>, cut boolean, first long, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>"
)
_OPEN = (
    "row long, chunk long, cut boolean, first long, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>, "
    "at long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"
)


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def _yields(groups: Groups) -> dict:
    pairs, times = linked(groups)
    return {
        "n_groups": len(groups.n_a), "n_links": int(np.dot(groups.n_a, groups.n_b)),
        "pairs": pairs.astype(np.int32), "times": times.astype(np.int32),
    }


def _opened(f: Fragment) -> dict:
    ends = (("prefix_a", f.prefix[0]), ("prefix_b", f.prefix[1]), ("suffix_a", f.suffix[0]), ("suffix_b", f.suffix[1]))
    return {"cut": f.cut} | {n: x.astype(np.int32) for n, x in ends}


def _document(a, a_end, b, b_end, full: bool) -> Iterator[dict]:
    """A row for a text of one range, else one for each of its ranges."""
    size = int(a_end[-1])
    n = -(-size // CHUNK)
    if n <= 1:
        groups = compose(BEGIN, fragment(a, a_end, b, b_end)).closed
        text = spelled(groups)
        yield {"n_a": len(a), "n_b": len(b), "digest": hashlib.sha256(text.encode()).hexdigest(), "groups": text if full else None} | _yields(groups)
        return
    edges = np.arange(1, n + 1) * CHUNK
    i, j = np.r_[0, np.searchsorted(a_end, edges, "right")], np.r_[0, np.searchsorted(b_end, edges, "right")]
    for k in range(n):
        x, y = slice(i[k], i[k + 1]), slice(j[k], j[k + 1])
        f = fragment(a[x], a_end[x], b[y], b_end[y])
        f = f if k else compose(BEGIN, f)
        yield {
            "chunk": k, "n_a": len(a[x]), "n_b": len(b[y]), "groups": spelled(f.closed) or None, "first": k if f.cut else None,
        } | _yields(f.closed) | _opened(f)


def _tokens(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, full: bool) -> Iterator[pa.RecordBatch]:
    two = Two(path_a, path_b)

    def rows(held: list[tuple[int, int | None, str]]) -> Iterator[pa.RecordBatch]:
        out, links = [], 0
        for (row, doc, _), tokens in zip(held, two.texts([t for *_, t in held])):
            for found in [{}] if tokens is None else _document(*tokens, full):
                out.append({"row": row, "doc_id": doc} | found)
                links += len(found.get("pairs", ()))
                if links > 1_000_000 or len(out) == 5000:
                    yield _batch(out, _PARTS)
                    out, links = [], 0
        if out:
            yield _batch(out, _PARTS)

    for batch in batches:
        held, chars = [], 0
        for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            held.append((row, doc, text.as_py() or ""))
            chars += len(held[-1][2])
            if chars > _CHARS:
                yield from rows(held)
                held, chars = [], 0
        if held:
            yield from rows(held)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of neighbouring ranges become one; groups closed by that are rows of
    their own, placed before the range whose first cut closed them."""
    ids = lambda x: np.array(x or (), dtype=np.int64)
    for table in neighbours(batches, ("row", "above")):
        rows, out, whole, first = table.to_pylist(), [], EMPTY, None
        for r in rows:
            part = Fragment(r["cut"], (ids(r["prefix_a"]), ids(r["prefix_b"])), NO_GROUPS, (ids(r["suffix_a"]), ids(r["suffix_b"])))
            whole = compose(whole, part)
            if len(whole.closed.n_a):
                out.append({"row": r["row"], "at": 2 * r["first"], "groups": spelled(whole.closed)} | _yields(whole.closed))
                whole = whole._replace(closed=NO_GROUPS)
            first = r["first"] if first is None else first
        out.append({"row": rows[0]["row"], "chunk": rows[0]["above"], "first": first} | _opened(whole))
        yield _batch(out, _OPEN)


def _digested(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    """One digest for each document, over its groups in order."""
    for table in neighbours(batches, ("row",)):
        text = ";".join(x for x in table.column("groups").to_pylist() if x)
        found = {"row": table.column("row")[0].as_py(), "digest": hashlib.sha256(text.encode()).hexdigest(), "groups": text if full else None}
        yield _batch([found], "row long, digest string, groups string")


def _reduced(parts: DataFrame, full: bool) -> tuple[DataFrame, DataFrame]:
    """(documents of many ranges, their links) from their fragments."""
    closed = parts.select("row", (2 * F.col("chunk") + 1).alias("at"), "n_groups", "n_links", "groups", "pairs", "times")
    ends = ("row", "chunk", "cut", "first", "prefix_a", "prefix_b", "suffix_a", "suffix_b")
    level = parts.select(*ends)
    while not level.where("chunk > 0").isEmpty():
        dealt = level.withColumn("above", F.floor(F.col("chunk") / FAN)).repartition("row", "above")
        made = stored(dealt.sortWithinPartitions("row", "above", "chunk").mapInArrow(_composed, _OPEN), "composed")
        closed = closed.unionByName(made.where("at IS NOT NULL").select(*closed.columns))
        level = made.where("at IS NULL").select(*ends)
    sums = closed.groupBy("row").agg(F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"))
    sizes = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    in_order = closed.select("row", "at", "groups").repartition("row").sortWithinPartitions("row", "at")
    digests = in_order.mapInArrow(lambda it: _digested(it, full), "row long, digest string, groups string")
    links = _links(closed).groupBy("row", "pair").agg(F.sum("times").alias("times"))
    return sizes.join(sums, "row").join(digests, "row"), links


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("row", "times", F.posexplode("pairs").alias("i", "pair")).select("row", "pair", F.get("times", F.col("i")).cast("long").alias("times"))


def align(docs: DataFrame, path_a: str, path_b: str, full: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and (``full``)
    groups for each row.  The paths are tokenizer files that every executor has."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    parts = stored(texts.mapInArrow(lambda it: _tokens(it, path_a, path_b, full), _PARTS), "fragments")
    fields = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "groups"]
    whole, long = parts.where("chunk IS NULL"), parts.where("chunk IS NOT NULL")
    rows, links = whole.select(*fields), _links(whole)
    if not long.isEmpty():
        more, more_links = _reduced(long, full)
        rows, links = rows.unionByName(more.select(*fields)), links.unionByName(stored(more_links, "links"))
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = stored(counts, "pair-counts")
    top = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("docs").alias("most"))
    ranked = counts.join(top, F.shiftright("pair", _SHIFT) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    if counts.count() <= FEW_PAIRS:
        met = links.join(F.broadcast(ranked), "pair")
    else:
        salted = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select(
        "doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("digest", F.lit("")).alias("groups_sha256"),
        *([F.coalesce("groups", F.lit("")).alias("groups")] if full else []),
    )
