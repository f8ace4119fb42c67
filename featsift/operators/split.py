"""Exact, deterministic hold-out splits.

Rows are ordered by ``md5(seed ':' row_id)`` (equal in Spark and DuckDB), and
the first ``n_test`` rows are the test part.  The order is a global rank
computed without a single-task window (``ranking.sequence_by``); the
stratified split ranks over ``(label, hash)`` and subtracts each class's start
offset, so a dominant class never lands in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.ranking import sequence_by


def _hash(seed: int, key: str = "row_id") -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def n_test_rows(n: int, test_size: float) -> int:
    return int(math.ceil(test_size * n))


HASH_BUCKETS = 1_000_000
MAX_CLASSES = 10_000


def split_hash(rows: DataFrame, test_size: float = 0.15, seed: int = 42, key: str = "row_id",
               label: str | None = None) -> DataFrame:
    """K1/K2 without a sort: a row is test when its hash bucket falls under
    ``test_size``.  No shuffle at all; sizes (and, with ``label``, class ratios)
    are right only in expectation.  For row counts where ranking every id is
    too costly; the exact splits are the default."""
    keys = [F.lit(seed), F.col(key)] + ([F.col(label)] if label else [])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS))
    cut = F.lit(int(round(test_size * HASH_BUCKETS)))
    return rows.withColumn("split", F.when(bucket < cut, "test").otherwise("train"))


def split_random(rows: DataFrame, test_size: float = 0.15, seed: int = 42, key: str = "row_id",
                 exact: bool = True) -> DataFrame:
    """K1: adds ``split`` = 'test' for the first ceil(f*n) rows of the hash order, else 'train'
    (``exact=False``: ``split_hash``, no sort, approximate size)."""
    if not exact:
        return split_hash(rows, test_size, seed, key)
    n = rows.count()
    n_test = n_test_rows(n, test_size)
    ranked = sequence_by(rows.withColumn("__h", _hash(seed, key)), [F.col("__h"), F.col(key)], "__r")
    return ranked.withColumn("split", F.when(F.col("__r") <= n_test, "test").otherwise("train")).drop("__h", "__r")


def stratified_quotas(class_counts: dict[int, int], test_size: float) -> dict[int, int]:
    """Test rows per class: train quotas by largest remainder over n_train
    (ties: smaller label first), test = class count - train quota."""
    n = sum(class_counts.values())
    n_test = n_test_rows(n, test_size)
    n_train = n - n_test
    labels = sorted(class_counts)
    base = {c: (n_train * class_counts[c]) // n for c in labels}
    rem = {c: (n_train * class_counts[c]) % n for c in labels}
    left = n_train - sum(base.values())
    for c in sorted(labels, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return {c: class_counts[c] - base[c] for c in labels}


def split_stratified(rows: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = 42,
                     key: str = "row_id", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """K2: per-class exact quotas; the first quota rows of each class's hash order are test."""
    got = rows.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    counts = {int(r[0]): int(r[1]) for r in got}
    if len(got) > MAX_CLASSES:
        raise ValueError("too many classes for a stratified split")
    quota = stratified_quotas(counts, test_size)
    start, acc = {}, 0
    for c in sorted(counts):
        start[c] = acc
        acc += counts[c]
    ranked = sequence_by(rows.withColumn("__h", _hash(seed, key)), [F.col(label), F.col("__h"), F.col(key)], "__r")
    start_m = F.create_map(*[x for c in sorted(start) for x in (F.lit(c), F.lit(start[c]))])
    quota_m = F.create_map(*[x for c in sorted(quota) for x in (F.lit(c), F.lit(quota[c]))])
    in_class = F.col("__r") - F.element_at(start_m, F.col(label))
    return ranked.withColumn(
        "split", F.when(in_class <= F.element_at(quota_m, F.col(label)), names[1]).otherwise(names[0])
    ).drop("__h", "__r")


def split_three_way(rows: DataFrame, label: str = "label", seed: int = 42, first: float = 0.4,
                    second: float = 0.5, key: str = "row_id") -> DataFrame:
    """K3: stratified 60/20/20: hold out 40 %, then split that half/half into valid/test."""
    s1 = split_stratified(rows, label, first, seed, key, ("train", "temp"))
    temp = s1.where(F.col("split") == "temp").drop("split")
    s2 = split_stratified(temp, label, second, seed, key, ("valid", "test"))
    return s1.where(F.col("split") == "train").unionByName(s2)
