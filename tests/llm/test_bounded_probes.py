"""Probes are dealt by their own number and stream behind the index rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featsift.llm import common, exact_dedup, line_dedup
from tests.llm import brute


@pytest.fixture
def groups(monkeypatch):
    """The sizes of the groups that behind_index makes."""
    sizes = []

    def noted(*args):
        out = common.behind_index(*args)
        sizes.extend(r["count"] for r in out.where("probe").groupBy("shard", "salt").count().collect())
        return out

    for module in (line_dedup, exact_dedup):
        monkeypatch.setattr(module, "behind_index", noted)
        monkeypatch.setattr(module, "PROBE_ROWS", 100)
    monkeypatch.setattr(line_dedup, "LEAST_PROBES", 50)
    return sizes


def test_few_shared_lines_among_many(spark, groups):
    rows = [(d, "\n".join([f"shared line {d % 7} of the text"] + [f"own line {d} {k} of the text" for k in range(40)])) for d in range(200)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows)
    assert sum(groups) == 200 * 41 and max(groups) < 250


def test_a_line_in_every_document_is_answered_by_the_index_in_many_groups(spark, groups):
    rows = [(d, f"the same line in every document\nown line {d} of this text") for d in range(4000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows)
    # Every line is a probe, and the group of the hot line's shard is split.
    assert sum(groups) == 8000 and max(groups) < 250


def test_every_distinct_line_is_indexed(spark):
    lines = spark.createDataFrame([(d, line_dedup.line_hash(f"a line of text {k}".encode())) for d in range(20) for k in range(d)], "d long, h binary")
    index, hot, _, probes = line_dedup.line_index(lines)
    assert index.agg(F.sum("n")).first()[0] == 19 and probes == 190 and hot.count() == 0


def test_rows_without_id_do_not_meet_each_other(spark):
    rows = [(1, "first line of the text\nsecond line of the text")] + [(None, f"first line of the text\nanother line {k} of text") for k in range(3000)]
    got = line_dedup.lost_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 3000 and got.agg(F.max(F.size("lost"))).first()[0] == 1


def test_small_snapshot_and_many_new(spark, groups):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    snap = exact_dedup.snapshot(make([(1, "a"), (2, "a"), (3, "b")]))
    new = [(10 + i, f"new {i}") for i in range(5000)] + [(9, "a")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(make(new), snap).collect()}
    assert got == {d: (d, 3 if d == 9 else 1) for d, _ in new}
    assert sum(groups) == 5001 and max(groups) < 250


def test_texts_without_id_are_compared_by_digest(spark):
    texts = [f"a text without id {k}" for k in range(2000)]
    old, new = (spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string") for _ in range(2))
    snap = exact_dedup.snapshot(old)
    batch = exact_dedup.grouped(exact_dedup.digested(new))
    met = exact_dedup.members(batch, new.select(F.lit(common.NULL_ID).alias("d"), common.body().alias("raw")), snap)
    assert met.count() == 2000
    got = exact_dedup.dedup(new, snap).collect()
    assert len(got) == 2000 and all(r.group_size == 2 and r.doc_id is None for r in got)


@pytest.mark.parametrize("size", [1, 4, 100])
def test_probed_batches(size):
    """Batches cut anywhere; shards without an index row or without probes."""
    rng = np.random.default_rng(size)
    rows = []
    for shard in range(12):
        for salt in range(2):
            rows += [(shard, False, shard * 10)] * (shard % 3 > 0)
            rows += [(shard, True, None)] * int(rng.integers(0, 6))
    schema = pa.schema([("shard", pa.int32()), ("probe", pa.bool_()), ("value", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[a:a + size]], schema) for a in range(0, len(rows), size)]
    got = [(row["value"], s) for row, b in common.probed(iter(batches), dict) for s in b.column("shard").to_pylist()]
    assert all(b.num_rows <= size for _, b in common.probed(iter(batches), dict))
    assert got == [(s * 10, s) for s, probe, _ in rows if probe and s % 3]
