"""Repeats in periodic texts: linear time, whole results."""

import random
import time

import numpy as np
import pytest

from featsift.llm import suffix_dedup
from tests.llm import brute


@pytest.mark.parametrize("period", [1, 2, 401])
def test_five_megabytes(spark, period):
    rng = random.Random(period)
    unit = "".join(rng.choice("abcdefgh") for _ in range(period))
    text = (unit * (5_000_000 // period + 1))[:5_000_000]
    docs = spark.createDataFrame([(1, text), (2, "short and clean")], "doc_id long, text string")
    t0 = time.time()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {1: (5_000_000, 5_000_000, 1), 2: (15, 0, 0)}
    assert time.time() - t0 < 60


@pytest.mark.parametrize("windows, size", [(50, 10**9), (50, 900), (7, 0)])
def test_cut_runs_and_large_files(spark, monkeypatch, windows, size):
    """Runs cut to pieces, files over the byte limit: as by brute force."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT_WINDOWS", windows)
    monkeypatch.setattr(suffix_dedup, "FILE_BYTES", size)
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(700)
    rows = [
        (1, "x" * 1500 + noise(100)), (2, "ab" * 450 + shared), (3, noise(300) + shared + "ab" * 430), (4, noise(450) + "x" * 410),
        (5, (noise(301) * 6)[:1600]), (6, shared[100:640]), (7, noise(900)), (8, (noise(401) * 3)[:1000]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute.remove_repeats(rows)


def test_longest_group_of_each_place():
    """The stack's answer against the longest of all groups that hold a place."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        common = np.r_[0, rng.integers(0, 6, n - 1)]
        before = rng.integers(-1, 3, n)
        groups, best = suffix_dedup.maximal_repeats(np.arange(n), common, before, 2)
        want = np.zeros(n, dtype=int)
        for lo, hi, t in groups:
            assert t == common[lo + 1:hi + 1].min() >= 2
            want[lo:hi + 1] = np.maximum(want[lo:hi + 1], t)
        assert want.tolist() == best.tolist()
