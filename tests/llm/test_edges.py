"""Empty tables, repeated rows, missing ids; the helpers; the pipeline."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from featsift.llm import (
    byte_bpe, exact_dedup, kernel_quality, line_dedup, mixing, paragraphs, quality_rules, sharding, simhash, suffix_dedup,
)
from featsift.llm.common import complete_groups
from featsift.llm.components import components
from featsift.llm.queries import VOCABULARY
from tests.conftest import SF_SMALL
from tests.llm import brute

LABELS = "doc_id long, quality int"
OPERATORS = {
    "quality": quality_rules.judged, "clean": quality_rules.keep_clean, "paragraphs": paragraphs.near_paragraphs,
    "lines": line_dedup.dedup_lines, "drop_lines": line_dedup.drop_lines, "copies": mixing.copies, "mix": mixing.mix,
    "near": simhash.near_groups, "keep_one": simhash.keep_one, "exact": exact_dedup.dedup_table,
    "tokens": lambda d: byte_bpe.encode(d, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN),
    "repeats": suffix_dedup.remove_repeats, "shard": sharding.shard,
    "score": lambda d: kernel_quality.score_quality(d, d.sparkSession.createDataFrame([], LABELS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_and_missing_ids(repeated, name):
    got = OPERATORS[name](repeated).collect()
    if name in ("quality", "lines", "drop_lines", "copies", "near", "exact", "tokens", "repeats", "shard", "score"):
        assert len(got) == 7
    if name == "near":
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1)]
    if name == "keep_one":
        assert len(got) == 3 and 1 in [r.doc_id for r in got]
    if name == "exact":
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in got) == [(0, 0, 1), (0, 0, 1), (0, 0, 5), (1, 0, 5), (1, 0, 5), (1, 0, 5), (2, 0, 5)]
    if name == "lines":
        assert sum(r.n_dropped for r in got) == 2
    if name == "paragraphs":
        assert len(got) == 5 and sum(not r.removed for r in got) == 3
    if name == "score":
        assert {r.score for r in got} == {0.5}


def test_disagreeing_labels_are_left_out(spark, small):
    rows = [(d, 1) for d in range(100)] + [(d, 0) for d in range(100)]
    got = kernel_quality.score_quality(small, spark.createDataFrame(rows, LABELS)).collect()
    assert {r.score for r in got} == {0.5}


@pytest.mark.parametrize("block", [1, 7, 1000])
@pytest.mark.parametrize("limit", [1, 3, 50])
def test_complete_groups(block, limit):
    rng = random.Random(block * limit)
    keys = sorted(rng.randrange(12) for _ in range(60)) + [99] * 30
    rows = list(enumerate(keys))
    batches = [pa.RecordBatch.from_pylist([{"k": k, "i": i} for i, k in rows[a:a + 8]]) for a in range(0, 90, 8)]
    whole, passed = [], []
    for complete, table in complete_groups(iter(batches), "k", limit, block):
        (whole if complete else passed).append(table.to_pylist())
    assert sorted(r["i"] for t in whole + passed for r in t) == list(range(90))
    for k in set(keys):
        homes = [sum(r["k"] == k for r in t) for t in whole if any(r["k"] == k for r in t)]
        n = keys.count(k)
        assert homes in ([], [n]) and (n <= limit) == bool(homes)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)]
    sets = brute.Sets()
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 60_000])
def test_filter_and_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    row = exact_dedup.fuse_filter(keys)
    assert exact_dedup.maybe_member(row, keys).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 50_000, dtype=np.uint64), keys)
    assert exact_dedup.maybe_member(row, others).mean() < 1e-3
    hashes = [int(k).to_bytes(16, "little") for k in rng.permutation(keys)]
    counts, docs = np.arange(len(hashes)) + 2, np.arange(len(hashes)) * 10
    shard = line_dedup.Shard(line_dedup.build_shard(hashes, counts, docs))
    got_counts, got_docs = shard.probe(hashes)
    assert (got_counts == counts).all() and (got_docs == docs).all() and len(shard.counts) == len(hashes)
    strangers = [int(k).to_bytes(8, "little") + b"strange!" for k in others[:1000]]
    assert (shard.probe(strangers)[0] == 0).all()


def test_bands_reach_the_recall():
    b = paragraphs.tune_bands(0.8, 0.999, 3)
    assert 1 - (1 - 0.8**3) ** b >= 0.999 > 1 - (1 - 0.8**3) ** (b - 1)


def test_incoming_batches(spark):
    """Two batches against a snapshot: members by exact buckets, new copies apart."""
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    snap = exact_dedup.snapshot(make([(1, "a"), (2, "a"), (3, "b")]))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(make([(10, "a"), (11, "new"), (12, "new")]), snap).collect()}
    assert got == {10: (10, 3), 11: (12, 2), 12: (12, 2)}


def test_pipeline(spark, small):
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF_SMALL)
        assert docs.columns == small.columns, name
        assert docs.count() <= 2 * before.count()
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    want = sorted((r.doc_id, brute.sha(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in out) == want and out
    rejected = {r.doc_id for r in quality_rules.judged(small).where("NOT kept").collect()}
    assert not rejected & {r.doc_id for r in out}


def test_pipeline_with_clashing_columns(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == awkward.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
