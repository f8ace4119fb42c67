"""Paragraph dedup: buckets bounded by bytes, documents without an id."""

import numpy as np
import pyarrow as pa
import pytest

from featsift.llm import paragraphs
from featsift.llm.common import complete_groups


def test_buckets_over_the_byte_limit(monkeypatch, awkward, middle):
    for docs in (awkward, middle):
        want = sorted(paragraphs.near_paragraphs(docs).collect())
        with monkeypatch.context() as few:
            few.setattr(paragraphs.paragraph_links, "__defaults__", (paragraphs.THRESHOLD, paragraphs.BUCKET_ROWS, 200))
            few.setattr(paragraphs, "BATCH_SHINGLES", 50)
            assert sorted(paragraphs.near_paragraphs(docs).collect()) == want


@pytest.mark.parametrize("block_bytes", [1, 300, 10**9])
def test_groups_are_whole_or_pass_through(block_bytes):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 60)
    sizes[[7, 30, 59]] = 90
    keys = np.repeat(np.arange(60), sizes)
    at = np.sort(rng.integers(0, len(keys), 12))
    cuts = [0, *at.tolist(), len(keys)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b])], names=["k"]) for a, b in zip(cuts, cuts[1:])]
    whole, passed = [], []
    for complete, table in complete_groups(iter(batches), "k", 10**6, block_bytes=block_bytes, limit_bytes=8 * 20):
        (whole if complete else passed).append(table.column("k").to_numpy())
    assert sorted(np.concatenate(whole).tolist() + np.concatenate(passed).tolist()) == keys.tolist()
    assert set(np.concatenate(passed).tolist()) == {7, 30, 59}
    for table in whole:
        for k in set(table.tolist()):
            assert (table == k).sum() == sizes[k]


def test_documents_without_an_id(spark):
    """Each text brings its own lines, however many rows share the missing id."""
    line = "alpha beta gamma delta epsilon zeta {}"
    rows = [(None, f"own line number {i} of this text\n" + line.format(i % 700)) for i in range(2100)]
    got = paragraphs.near_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    copies = [r for r in got if r.paragraph == 1]
    assert len(copies) == 2100
    assert {r.n_paragraphs for r in copies} == {3} and {r.component_id for r in got} == {None}
