"""Cost-balanced packing of documents into token sequences.

A sequence's estimated cost is linear in its tokens (projections, feed-forward) plus
quadratic in each of its pieces (attention inside a document).  Each task takes its
rows in runs of about ``RUN_TOKENS`` tokens.  Of a run,

1. documents longer than a sequence give their full windows to sequences of their own;
2. what is left of them and all other documents, in descending cost, go each to the
   sequence of lowest cost that has room for the whole of it;
3. where none has, the document is cut: the lowest-cost sequence with any room takes
   what fits, and so on.

There are as many sequences as the run's tokens need, so less than one sequence of a
run is padding, and most documents stay whole.  Nothing is shuffled: a run holds
lengths and ids of a bounded number of tokens (or one longer document), and partitions
are merged only where they are too small to fill a run.

Ids come from the tokenizer word by word: its normaliser and pattern never look across
a space or a line feed, so a text is cut there and each distinct word is encoded once
in a worker process, which keeps up to about ``REMEMBERED`` words from task to task.

Defined cases: a null text is empty, an empty text is its end token alone; null and
repeated doc_ids are rows of their own; ties in cost go to the earlier row and the
lower sequence; any length of text works; empty input gives an empty result; extra
columns are never read.
"""

from __future__ import annotations

import os
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featsift.llm.common import body

CAPACITY = 2048
END = 1
LINEAR, QUADRATIC = 4096, 1  # cost of a piece: LINEAR * n + QUADRATIC * n * n
RUN_TOKENS = 1_500_000  # tokens packed together, about
RUN_BYTES = 4_000_000  # a partition should hold so much text
REMEMBERED = 1_000_000  # words remembered by a worker process
_AT_ONCE = 10_000  # runs of letters encoded in one call
_CHARS = 6_000_000  # text tokenized in one go


class Words:
    """Ids of texts under a tokenizer that looks at each white-space word by itself.

    Its pattern takes a run of letters as one word, to which it adds an end mark, and
    a run of other signs as another.  A word of letters with ASCII punctuation behind
    is therefore its letters' ids and its punctuation's; distinct runs of letters are
    encoded many in one call, and told apart by the end marks.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of distinct words."""
        cut = []
        for word in words:
            letters = word.rstrip(string.punctuation)
            if not letters.isalpha():
                letters = word
            tail = word[len(letters):]
            cut.append((letters.lower() if letters.isascii() else letters, tail))
        new = {x for parts in cut for x in parts if x not in self.parts}
        runs = [x for x in new if (x if x.isascii() else unicodedata.normalize("NFC", x).lower()).isalpha()]
        for lo in range(0, len(runs), _AT_ONCE):
            part = runs[lo:lo + _AT_ONCE]
            ids = self._ids([" ".join(part)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):  # else a letter that this tokenizer does not know as one
                raw, stops = ids.tobytes(), (stops * 4).tolist()
                self.parts.update((x, raw[i:j]) for x, i, j in zip(part, [0, *stops], stops))
        rest = [x for x in new if x not in self.parts]
        self.parts.update((x, ids.tobytes()) for x, ids in zip(rest, self._ids(rest)))
        self.known.update((word, self.parts[a] + self.parts[b]) for word, (a, b) in zip(words, cut))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known, self.parts = {"": b""}, {"": b""}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn([w for w in set().union(*split) if w not in self.known])
        for words in split:
            yield b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def _words_of(path: str, changed: int, size: int) -> Words:
    return Words(path)


def shared_words(path: str) -> Words:
    """The ``Words`` of a tokenizer file that this worker process keeps for its tasks."""
    at = os.stat(path)
    return _words_of(path, at.st_mtime_ns, at.st_size)


def cost(n, linear: int = LINEAR, quadratic: int = QUADRATIC):
    return linear * n + quadratic * n * n


def balanced(lengths: np.ndarray, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths,
    sequences numbered from 0."""
    lengths = np.asarray(lengths, dtype=np.int64)
    full, rest = lengths // capacity, lengths % capacity
    owner = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    alone = np.column_stack([owner, nth * capacity, np.full(len(owner), capacity), np.arange(len(owner)), np.zeros(len(owner), dtype=np.int64)])
    n = -(-int(rest.sum()) // capacity)
    load, room = np.zeros(n, dtype=np.int64), np.full(n, capacity, dtype=np.int64)
    never = np.iinfo(np.int64).max
    pieces = []
    for d in np.argsort(-rest, kind="stable")[:np.count_nonzero(rest)].tolist():
        start, left = int(full[d]) * capacity, int(rest[d])
        while left:
            fits = room >= left
            k = int(np.where(fits, load, never).argmin())
            if not fits[k]:
                k = int(np.where(room > 0, load, never).argmin())
            take = min(left, int(room[k]))
            pieces.append((d, start, take, len(owner) + k, capacity - int(room[k])))
            room[k] -= take
            load[k] += cost(take, linear, quadratic)
            start, left = start + take, left - take
    return np.concatenate([alone, np.array(pieces, dtype=np.int64).reshape(-1, 5)])


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """One row for each piece: doc_id, start and length (in its document's ids, whose
    last is ``END``), ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset there.  ``path``: a tokenizer file that every executor has."""
    end = np.array([END], dtype="<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequences = shared_words(path), TaskContext.get().partitionId() << 32

        def run(held: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            sizes = np.array([len(raw) // 4 for _, raw in held], dtype=np.int64)
            found = balanced(sizes, capacity, linear, quadratic)
            for lo in range(0, len(found), 4096):
                part = found[lo:lo + 4096]
                cut = [held[d][1][4 * s:4 * (s + n)] for d, s, n in part[:, :3].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[d][0] for d in part[:, 0].tolist()], pa.int64()), pa.array(part[:, 1]), pa.array(part[:, 2]),
                        pa.array(cut, pa.binary()), pa.array(sizes[part[:, 0]]), pa.array(sequences + part[:, 3]), pa.array(part[:, 4]),
                    ],
                    names=[f.split()[0] for f in _PIECES.split(", ")],
                )
            sequences += int(found[:, 3].max()) + 1

        held, tokens = [], 0
        for ids, texts in _taken(batches):
            for doc, raw in zip(ids, words.encode(texts)):
                held.append((doc, raw + end))
                tokens += len(raw) // 4 + 1
                if tokens >= RUN_TOKENS:
                    yield from run(held)
                    held, tokens = [], 0
        if held:
            yield from run(held)

    size = docs.select(F.sum(F.octet_length(body()).cast("long"))).first()[0] or 0
    return docs.select(F.col("doc_id").cast("long"), "text").coalesce(max(1, size // RUN_BYTES)).mapInArrow(packed, _PIECES)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``_CHARS`` characters at most, one longer text apart."""
    for batch in batches:
        ids, texts, chars = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc)
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars > _CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts
