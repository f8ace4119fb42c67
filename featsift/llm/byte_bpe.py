"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Each task keeps an in-memory DuckDB with the merge table (every pair of tokens whose
bytes joined are a token, with its rank).  The distinct words of a batch of texts
become rows of token lists; a recursive query unnests them to token-position rows,
joins the merge table, takes each word's leftmost pair of smallest rank and contracts
it, until no word has a pair left.  A second query joins the tokens with their bytes
and gathers them in order: the decoded word.  A text is the row of its words.

Words are the pattern's matches.  No match spans the place between a character that
is not white space and a following space, so a text is first cut there, and only
distinct pieces meet the pattern and the database.

Texts are independent, so there is no shuffle, and a lost task is simply run again.
Defined cases: null text is empty (no tokens); repeated rows are encoded alike;
strings of special tokens are ordinary text; any length of text or word works
(words over ``LONG_WORD`` bytes keep only their latest list during the recursion);
empty input gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_WORD = 64
WORDS_AT_ONCE = 40_000
CACHED = 400_000  # pieces of text, and as many words, remembered by a task
BATCH_CHARS = 6_000_000

# One contraction: position rows of each word, their pairs' ranks, the leftmost least.
_STEP = """
  SELECT s.w, l[:place-1] || [merged] || l[place+2:] FROM s JOIN (
    SELECT w, min(id::BIGINT << 24 | p) AS least, (least & 16777215)::INT AS place, (least >> 24)::INT AS merged
    FROM (SELECT w, unnest(l[:-2]) AS a, unnest(l[2:]) AS b, unnest(range(1, len(l))) AS p FROM s) AS pairs
    JOIN merges ON ab = (a::BIGINT << 24 | b) GROUP BY w) AS chosen ON chosen.w = s.w"""
_ENCODE = f"WITH RECURSIVE s(w, l) AS (SELECT w, l FROM words UNION ALL {_STEP}) SELECT w, arg_min(l, len(l)) AS l FROM s GROUP BY w"
_ENCODE_LONG = f"WITH RECURSIVE s(w, l) USING KEY (w) AS (SELECT w, l FROM words UNION {_STEP}) SELECT w, l FROM s"
_DECODE = """
SELECT w, list(bytes ORDER BY p) AS b
FROM (SELECT w, unnest(l) AS id, unnest(range(len(l))) AS p FROM encoded) AS tokens JOIN vocabulary USING (id) GROUP BY w"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _column(db: duckdb.DuckDBPyConnection, query: str) -> pa.ListArray:
    column = db.sql(query).to_arrow_table().column(0).combine_chunks()
    values = column.values.cast(pa.binary()) if pa.types.is_large_binary(column.values.type) else column.values
    return pa.ListArray.from_arrays(column.offsets.cast(pa.int32()), values)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words_of = ranks, regex.compile(pattern).findall
        self.after_space, self.pieces_of = regex.compile(r"\s ").search, regex.compile(r"\s*\S+|\s+").findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]] << 24 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self._table("merges", {"ab": pa.array([p[0] for p in pairs], pa.int64()), "id": pa.array([p[1] for p in pairs], pa.int32())})
        self._table("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        # Ids, as little-endian 32-bit numbers, and decoded bytes of words and of pieces.
        self.ids: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.piece_ids: dict[str, bytes] = {}
        self.piece_plain: dict[str, bytes] = {}

    def _table(self, name: str, columns: dict) -> None:
        given = pa.table(columns)  # noqa: F841  read by the query below
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")

    def words(self, words: list[str]) -> None:
        """Learn the ids and the decoded bytes of distinct words."""
        raw = [w.encode() for w in words]
        for query, some in ((_ENCODE, [i for i, b in enumerate(raw) if len(b) <= LONG_WORD]), (_ENCODE_LONG, [i for i, b in enumerate(raw) if len(b) > LONG_WORD])):
            for lo in range(0, len(some), WORDS_AT_ONCE):
                part = some[lo:lo + WORDS_AT_ONCE]
                # A word that is a token as a whole is that token; the others start as bytes.
                whole = np.array([self.ranks.get(raw[i], -1) for i in part])
                start = [raw[i] if r < 0 else b"\0" for i, r in zip(part, whole.tolist())]
                offsets = np.r_[0, np.cumsum([len(x) for x in start])].astype(np.int32)
                ids = self.byte[np.frombuffer(b"".join(start), dtype=np.uint8)]
                ids[offsets[:-1][whole >= 0]] = whole[whole >= 0]
                self._table("words", {"w": pa.array(part, pa.int32()), "l": pa.ListArray.from_arrays(offsets, ids)})
                self.db.execute(f"CREATE OR REPLACE TABLE encoded AS {query}")
                # Both results come in order of w, so their rows belong together.
                ids = _column(self.db, "SELECT l FROM encoded ORDER BY w")
                texts = _column(self.db, f"SELECT b FROM ({_DECODE}) ORDER BY w")
                names = [words[i] for i in part]
                tokens, at = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
                self.ids.update(zip(names, (tokens[i:j] for i, j in zip(at, at[1:]))))
                # The bytes of a word's tokens lie one after the other.
                ends = np.frombuffer(texts.values.buffers()[1], dtype=np.int32)[texts.offsets.to_numpy()].tolist()
                plain = texts.values.buffers()[2].to_pybytes()
                self.plain.update(zip(names, (plain[i:j] for i, j in zip(ends, ends[1:]))))

    def split(self, text: str) -> list[str]:
        if self.after_space(text):
            return self.pieces_of(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def forget(self, most: int = 0) -> None:
        """Drop what is remembered beyond ``most`` entries."""
        for memories in ((self.ids, self.plain), (self.piece_ids, self.piece_plain)):
            if len(memories[0]) > most:
                for memory in memories:
                    memory.clear()

    def close(self) -> None:
        """Give the memory back: a worker process outlives its task and shares the
        executor with the tasks of later stages."""
        self.forget()
        self.db.close()
        pa.default_memory_pool().release_unused()

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """The ids and the decoded bytes of each text."""
        self.forget(CACHED)
        split = [self.split(t) for t in texts]
        new = [p for p in set().union(*split) if p not in self.piece_ids]
        found = [self.words_of(p) for p in new]
        self.words(sorted(w for w in set().union(*found) if w not in self.ids))
        ids, plain = self.ids.__getitem__, self.plain.__getitem__
        self.piece_ids.update((p, b"".join(map(ids, words))) for p, words in zip(new, found))
        self.piece_plain.update((p, b"".join(map(plain, words))) for p, words in zip(new, found))
        ids, plain = self.piece_ids.__getitem__, self.piece_plain.__getitem__
        for pieces in split:
            yield b"".join(map(ids, pieces)), b"".join(map(plain, pieces))


_OUT = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, pattern: str, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (``full``) ids and decoded, for
    each row.  ``path``: a rank file of fixed size; its ranks are broadcast."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_ranks(path))
    fields = [f for f in T.StructType.fromDDL(_OUT) if full or f.name not in ("ids", "decoded")]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value, pattern)

        def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
            columns: dict[str, list] = {f.name: [] for f in fields}
            for doc, (tokens, raw) in zip(ids, codec.texts(texts)):
                columns["doc_id"].append(doc)
                columns["n_tokens"].append(len(tokens) // 4)
                columns["ids_sha256"].append(hashlib.sha256(tokens).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                if full:
                    columns["ids"].append(np.frombuffer(tokens, dtype="<i4"))
                    columns["decoded"].append(raw.decode())
            types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], types.get(f.name, pa.string())) for f in fields], names=[f.name for f in fields])

        try:
            for batch in batches:
                ids, texts, chars = [], [], 0
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append(doc)
                    texts.append(text.as_py() or "")
                    chars += len(texts[-1])
                    if chars > BATCH_CHARS:
                        yield rows(ids, texts)
                        ids, texts, chars = [], [], 0
                yield rows(ids, texts)
        finally:
            codec.close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(coded, T.StructType(fields))
