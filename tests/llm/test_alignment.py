"""Alignment of two tokenizers against a plain version, and the laws of its monoid."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featsift.llm import alignment as A
from featsift.llm.queries import ALIGNED_VOCABULARIES
from tests.llm.conftest import awkward_rows, pairs

PATHS = [public_tokenizers.path(n) for n in ALIGNED_VOCABULARIES]
MORE = [
    "trail  ", " ", "  ", "x▁y", "nul\0x", "<s> </s> <unk> <|endoftext|> <0x41>", "\n a\tb \r\n c", "　  \x85x \x1c y",
    "漢字かな交じり文の長い文章です。" * 30, "日本 語" * 5, "🙂🙂 🙂👍🏽", "ab" * 3000, "؀" * 40, "=" * 500 + " " + "-" * 900, " " * 700 + "end",
]


def plain(rows):
    """Everything by hand, over [(doc_id, text)]."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    sign = A._byte_level()
    name = {i: t for t, i in a.get_vocab().items()}
    out, docs = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            x = [(i, bytes(sign[c] for c in name[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y):
                ends = lambda tokens: np.cumsum([len(t) for _, t in tokens]).tolist()
                ex, ey = ends(x), ends(y)
                cut = sorted(set(ex) & set(ey))
                for lo, hi in zip([0, *cut], cut):
                    groups.append(([i for (i, _), e in zip(x, ex) if lo < e <= hi], [i for (i, _), e in zip(y, ey) if lo < e <= hi])) if len(raw) < 3000 else None
                if len(raw) >= 3000:
                    i = j = 0
                    for c in cut:
                        k, m = ex.index(c, i) + 1, ey.index(c, j) + 1
                        groups.append(([t for t, _ in x[i:k]], [t for t, _ in y[j:m]]))
                        i, j = k, m
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        docs.update(links.keys())
        out.append((doc, groups, links))
    most = defaultdict(int)
    for (p, _), n in docs.items():
        most[p] = max(most[p], n)
    return sorted(
        (
            -1 if doc is None else doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
            sum(n for k, n in links.items() if docs[k] == most[k[0]]), sum(n * docs[k] for k, n in links.items()),
            hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups).encode()).hexdigest() if groups else "",
        )
        for doc, groups, links in out
    )


def values(frame):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((-1 if r.doc_id is None else r.doc_id, *(r[n] for n in names)) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    return [(d, t) for d, t, *_ in awkward_rows()] + [(1000 + i, t) for i, t in enumerate(MORE)]


@pytest.mark.parametrize("chunk, few", [(32_768, 10**9), (40, 10**9), (7, 0)])
def test_awkward_rows(spark, rows, chunk, few, monkeypatch):
    """Whole texts, many ranges, ranges shorter than tokens; both joins with the counts."""
    monkeypatch.setattr(A, "CHUNK", chunk)
    monkeypatch.setattr(A, "FEW_PAIRS", few)
    some = rows if chunk > 7 else [r for r in rows if len(r[1] or "") < 3000]
    frame = spark.createDataFrame(some, "doc_id long, text string")
    got = A.align(frame, *PATHS)
    assert values(got) == plain(some)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 or r.groups == r.groups_sha256 == "" for r in got.collect())


def test_clashing_columns(awkward):
    assert values(A.align(awkward, *PATHS, full=False)) == plain(pairs(awkward))


def test_whole_table(small):
    assert values(A.align(small, *PATHS, full=False)) == plain(pairs(small))


def test_repeated_and_empty(repeated, empty):
    assert values(A.align(repeated, *PATHS)) == plain(pairs(repeated))
    assert A.align(empty, *PATHS).collect() == []


def test_large_groups_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    n_a, n_b = rng.integers(1, 60, 50), rng.integers(1, 60, 50)
    groups = A.Groups(rng.integers(0, 9, n_a.sum()), n_a, rng.integers(0, 9, n_b.sum()), n_b)
    want = A.linked(groups)
    monkeypatch.setattr(A, "_SPREAD", 100)
    assert all((x == y).all() for x, y in zip(A.linked(groups), want))


ends = st.lists(st.integers(1, 4), max_size=12)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.lists(st.integers(0, 50), min_size=2, max_size=2))
def test_monoid_laws(x, y, at):
    """Composition is associative, has a unit, and of parts gives the whole."""
    x, y = np.cumsum(x, dtype=np.int64), np.cumsum(y, dtype=np.int64)
    a, b = np.arange(len(x)), np.arange(len(y)) + 100
    whole = A.fragment(a, x, b, y)
    lo, hi = sorted(at)
    parts = []
    for p, q in ((0, lo), (lo, hi), (hi, 10**6)):
        i, j = (x > p) & (x <= q), (y > p) & (y <= q)
        parts.append(A.fragment(a[i], x[i], b[j], y[j]))
    f, g, h = parts
    flat = lambda z: [z.cut, *(v.tolist() for v in (*z.prefix, *z.closed, *z.suffix))]
    assert flat(A.compose(A.compose(f, g), h)) == flat(A.compose(f, A.compose(g, h))) == flat(whole)
    assert flat(A.compose(A.EMPTY, f)) == flat(f) == flat(A.compose(f, A.EMPTY))
