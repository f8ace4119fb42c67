"""Packing: every id once, sequences full and gapless, ids as the tokenizer gives them."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featsift.llm import packing
from featsift.llm.queries import PACKING_VOCABULARY
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path(PACKING_VOCABULARY)


def greedy(lengths, capacity):
    """The method step by step, with plain lists."""
    out, sequences = [], 0
    items = []
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            out.append((d, start, capacity, sequences, 0))
            start, sequences = start + capacity, sequences + 1
        if n > start:
            items.append((d, start, n - start))
    count = -(-sum(i[2] for i in items) // capacity)
    load, used = [0] * count, [0] * count
    for d, start, n in sorted(items, key=lambda i: -packing.cost(i[2])):
        while n:
            whole = [k for k in range(count) if used[k] + n <= capacity]
            some = whole or [k for k in range(count) if used[k] < capacity]
            k = min(some, key=lambda k: (load[k], k))
            take = min(n, capacity - used[k])
            out.append((d, start, take, sequences + k, used[k]))
            used[k] += take
            load[k] += packing.cost(take)
            start, n = start + take, n - take
    return out


@pytest.mark.parametrize("seed", range(6))
def test_balanced_equals_the_plain_method(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 1, 5, rng.randrange(1, 40), rng.randrange(1, 200), 64, 128]) for _ in range(rng.randrange(1, 80))]
    assert sorted(map(tuple, packing.balanced(np.array(lengths), 64).tolist())) == sorted(greedy(lengths, 64))


def test_costs_come_near_equal():
    rng = np.random.default_rng(0)
    pieces = packing.balanced(rng.integers(1, 700, 4000))
    load = np.zeros(pieces[:, 3].max() + 1)
    np.add.at(load, pieces[:, 3], packing.cost(pieces[:, 2]))
    assert load[:-1].max() < 1.15 * np.median(load)


def held(rows, capacity, want):
    """Checks the contract of ``rows`` against the documents' ids ``want`` {key: list of ids}."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, found in pieces.items():
        found.sort()
        assert [i for _, ids, _ in found for i in ids] == want[doc] and {n for *_, n in found} == {len(want[doc])}
        assert [s for s, *_ in found] == np.cumsum([0] + [len(ids) for _, ids, _ in found])[:-1].tolist()
    assert set(pieces) == set(want)
    padding = 0
    for found in sequences.values():
        found.sort()
        assert [o for o, _ in found] == np.cumsum([0] + [n for _, n in found])[:-1].tolist()
        used = sum(n for _, n in found)
        assert used <= capacity
        padding += 0 if used & (used - 1) == 0 else capacity - used
    return padding


def test_awkward_rows(awkward):
    tokenizer = Tokenizer.from_file(PATH)
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END] for d, t, *_ in awkward_rows()}
    assert held(packing.pack(awkward, PATH).collect(), packing.CAPACITY, want) < packing.CAPACITY


def test_whole_table_in_many_partitions(middle, monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    want = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [packing.END] for r in middle.collect()}
    padding = held(packing.pack(middle.repartition(40), PATH).collect(), packing.CAPACITY, want)
    assert padding <= packing.CAPACITY and padding < 0.01 * sum(map(len, want.values()))


def test_words_are_encoded_as_in_their_text():
    tokenizer, words = Tokenizer.from_file(PATH), packing.Words(PATH)
    texts = [t or "" for _, t, *_ in awkward_rows()] + [
        "a\x1cb \x85 c　d e", "<|endoftext|> x<|startoftext|>y  z", "é ́e Å", "ΣΑΣ Σ", "\r\n\t x\ty ", "don't 's ' s",
        "İx Kelvin,** x…! rock'n' don't! 'll's q's.", "क़ क़अ, 𞤀𞤢 ªº² aͅb ﬁ. A1. B²!", "ꟑ ꟓa 𐵐x",
    ]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in words.encode(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_and_repeated(empty, repeated):
    assert packing.pack(empty, PATH).collect() == []
    rows = packing.pack(repeated, PATH).collect()
    assert len(rows) == 7 and len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows)[0] == 0 and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows)
