"""Mixing, sharding, the classifier and the outlier rules: properties and accuracy."""

import zlib
from collections import defaultdict

from featsift.llm import kernel_quality, mixing, quality_rules, sharding
from tests.conftest import SF_MID
from tests.llm import brute
from tests.llm.conftest import pairs


def brute_targets(sizes):
    """{source: size} -> {source: target} by sharing out and resharing the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def check_mix(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    size = {r.doc_id: len(brute.words(r.text)) for r in rows}
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    want = brute_targets(sizes)
    taken = defaultdict(int)
    plan = mixing.copies(docs).collect()
    assert len(plan) == len(rows)
    for r in plan:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + r.target) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6
    again = {r.doc_id: r.copies for r in mixing.copies(docs).collect()}
    assert again == {r.doc_id: r.copies for r in plan}
    mixed = defaultdict(int)
    for r in mixing.mix(docs).collect():
        mixed[r.doc_id] += 1
    assert dict(mixed) == {d: c for d, c in again.items() if c}


def test_mix(middle):
    check_mix(middle)


def test_mix_awkward(awkward):
    check_mix(awkward)
    assert mixing.mix(awkward).columns == awkward.columns


def test_mix_repeated_rows(repeated):
    plan = mixing.copies(repeated).collect()
    assert mixing.mix(repeated).count() == sum(r.copies for r in plan)


def test_word_counts(awkward):
    got = {r.doc_id: r.n for r in awkward.select("doc_id", mixing.n_words().alias("n")).collect()}
    assert got == {d: len(brute.words(t)) for d, t in pairs(awkward)}


def check_shards(docs):
    out = sharding.shard(docs).collect()
    texts = [(d, (t or "").encode()) for d, t in pairs(docs)]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d, len(b) + 1, zlib.crc32(b)) for d, b in texts)
    load, slots = defaultdict(int), defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return [load[s] for s in range(8)], max(len(b) + 1 for _, b in texts)


def test_shards_even(middle):
    load, largest = check_shards(middle)
    assert max(load) - min(load) <= max(largest, 0.001 * sum(load))


def test_shards_awkward(awkward):
    load, largest = check_shards(awkward)
    assert max(load) - min(load) <= largest


def test_growing_moves_slots_only_into_the_new_shard():
    sizes = [(v * 7919) % 1000 + 1 for v in range(4096)]
    old = sharding.rebalanced(sharding.even_map(8), sizes, 8)
    new = sharding.rebalanced(old, sizes, 9)
    moved = [(a, b) for a, b in zip(old, new) if a != b]
    load = [sum(s for s, m in zip(sizes, new) if m == k) for k in range(9)]
    assert max(load) - min(load) < 1000 and sum(b == 8 for _, b in moved) > 0.95 * len(moved)


def test_map_versions(spark, tmp_path, middle):
    path = str(tmp_path / "map")
    sharding.shard(middle, path=path).count()
    first = [r.shard for r in sharding.load_map(spark, path, 1).orderBy("vslot").collect()]
    second = [r.shard for r in sharding.load_map(spark, path, 2).orderBy("vslot").collect()]
    assert first == sharding.even_map(8) and len(second) == sharding.SLOTS and first != second


def test_outliers_spare_good_documents(spark, middle):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = quality_rules.judged(middle).join(labels, "doc_id").withColumn("bad", quality_rules.base_failed("stats")).collect()
    good = [r for r in rows if r.quality == 1 and not r.bad]
    junk = [r for r in rows if r.quality == 0 and not r.bad]
    assert all(r.kept for r in good) and sum(r.kept for r in junk) < 0.2 * len(junk)


def test_estimate_resists_contamination(spark):
    """A third of wild rows moves neither location nor scatter much."""
    import numpy as np

    rng = np.random.default_rng(0)
    clean = rng.normal(size=(800, 6)) * 0.5 + 1
    wild = rng.normal(size=(200, 6)) * 0.1 + 9
    rows = spark.createDataFrame([("g", *map(float, r)) for r in np.vstack([clean, wild])], "g string, " + ", ".join(f"x{i} double" for i in range(6)))
    fit = quality_rules.robust_estimates(rows).first()
    assert all(abs(fit[f"m{i}"] - 1) < 0.1 for i in range(6))
    var = 0.25 + np.square(quality_rules.TOLERANCE)
    assert all(0.7 < 1 / fit[f"q{i}{i}"] / var[i] < 1.3 for i in range(6))


def test_classifier_on_held_out_rows(spark, middle):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = kernel_quality.score_quality(middle, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out)
    ones, zeros = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    assert wins >= 0.9 * len(ones) * len(zeros)


def test_classifier_never_reads_held_out_labels(spark, middle):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in kernel_quality.score_quality(middle, labels).collect()}
    b = {r.doc_id: r.score for r in kernel_quality.score_quality(middle, flipped).collect()}
    assert a == b


def test_isotonic_rises():
    import numpy as np

    total = np.array([4.0, 0, 4, 4, 4])
    at, heights = kernel_quality.isotonic(total, np.array([1.0, 0, 3, 1, 4]))
    assert list(heights) == sorted(heights) and len(at) == 3
