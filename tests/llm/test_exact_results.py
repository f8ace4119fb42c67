"""Operators against their brute-force versions, on driver rows and awkward ones."""

import public_tokenizers
import pytest
import tiktoken

from featsift.llm import byte_bpe, exact_dedup, line_dedup, paragraphs, quality_rules, simhash, suffix_dedup
from featsift.llm.queries import VOCABULARY
from tests.llm import brute
from tests.llm.conftest import pairs


@pytest.fixture(params=["middle", "awkward"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_base_statistics(docs):
    want = {d: brute.stats(t) for d, t in pairs(docs)}
    for r in quality_rules.judged(docs).withColumn("bad", quality_rules.base_failed("stats")).collect():
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, r.bad) == want[r.doc_id]
        assert not (r.bad and r.kept)


def test_lines(docs):
    want = brute.dedup_lines(pairs(docs))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want


def test_lines_in_place(awkward):
    out = line_dedup.drop_lines(awkward)
    assert out.columns == awkward.columns
    want = brute.dedup_lines(pairs(awkward))
    for r in out.collect():
        assert brute.sha(r.text or "") == want[r.doc_id][2]
        assert r.n_chars == len(r.text or "")


def test_near_groups(docs):
    prints = {d: brute.fingerprint(t) for d, t in pairs(docs)}
    want = brute.near_groups(prints)
    got = simhash.near_groups(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_paragraphs(docs):
    want = brute.near_paragraphs(pairs(docs))
    got = {(r.doc_id, r.paragraph): r for r in paragraphs.near_paragraphs(docs).collect()}
    assert set(got) == set(want)
    for spot, r in got.items():
        first, size = want[spot]
        assert (r.component_id, r.n_paragraphs, r.removed) == (first[0], size, spot != first)


def test_exact_copies(docs):
    by = {}
    for d, t in pairs(docs):
        by.setdefault(t or "", []).append(d)
    want = {d: (max(g), len(g), d == max(g), brute.sha(t)) for t, g in by.items() for d in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_table(docs).collect()}
    assert got == want


def test_tokens(docs):
    path = public_tokenizers.path(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = {d: t or "" for d, t in pairs(docs)}
    got = byte_bpe.encode(docs, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == texts[r.doc_id]
        assert r.ids_sha256 == brute.sha(b"".join(i.to_bytes(4, "little") for i in ids))
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id])


def _repeats(docs, **more):
    out = suffix_dedup.remove_repeats(docs, **more).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}


def test_repeats_small(small):
    assert _repeats(small) == brute.remove_repeats(pairs(small))


def test_repeats_awkward(awkward):
    assert _repeats(awkward) == brute.remove_repeats(pairs(awkward))


def test_repeats_over_the_file_limit(monkeypatch, small, awkward):
    monkeypatch.setattr(suffix_dedup.repeats, "__defaults__", (suffix_dedup.LENGTH, 2))
    assert _repeats(small) == brute.remove_repeats(pairs(small))
    assert _repeats(awkward) == brute.remove_repeats(pairs(awkward))


def test_repeat_groups_have_all_occurrences(small):
    raw = {d: (t or "").encode() for d, t in pairs(small)}
    groups = {}
    for r in suffix_dedup.repeat_groups(small).collect():
        groups.setdefault((r.array, r.lo, r.hi), []).append(r)
    assert groups
    for (_, lo, hi), spots in groups.items():
        assert len(spots) == hi - lo + 1
        assert len({raw[r.doc_id][r.start:r.start + r.size] for r in spots}) == 1 and spots[0].size >= suffix_dedup.LENGTH


def test_groups_over_the_limits(spark, middle, awkward):
    """The ways for groups that no single task may hold give the same results."""
    from featsift.llm.components import components

    prints = simhash.near_groups(awkward).select("fingerprint").distinct()
    fps = spark.createDataFrame([(simhash._signed(int(r.fingerprint, 16)),) for r in prints.collect()], "fp long")
    roots = [{(r.node, r.root) for r in components(simhash.print_links(fps, limit=n)).collect()} for n in (3, 20_000)]
    assert roots[0] == roots[1] and roots[0]


def test_paragraph_buckets_over_the_limit(monkeypatch, awkward):
    want = sorted(paragraphs.near_paragraphs(awkward).collect())
    monkeypatch.setattr(paragraphs.paragraph_links, "__defaults__", (paragraphs.THRESHOLD, 4, paragraphs.BUCKET_BYTES))
    assert sorted(paragraphs.near_paragraphs(awkward).collect()) == want
