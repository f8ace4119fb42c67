"""Penalised boosting against a NumPy version; stopping; resuming."""

import math

import numpy as np
import pytest

from featsift.operators import boosting as B
from featsift.operators.matrix import WideMatrix
from featsift.operators.models import XGB_PRESETS


def table(spark, seed, n=120, width=9, levels=4):
    """A sparse matrix with ties, negative values and an empty row; labels lean on two columns."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, levels, (n, width)).astype(float) * (rng.random((n, width)) < 0.5)
    x[0] = 0
    y = (x[:, 2] - x[:, 5] + rng.normal(0, 1, n) > 0.3).astype(int)
    cells = [(i, f"c{j}", float(x[i, j])) for i in range(n) for j in range(width) if x[i, j]]
    m = WideMatrix(
        entries=spark.createDataFrame(cells, "row_id long, feature_id string, value double"),
        rows=spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, label int"),
    )
    return m, x, y


def numpy_round(x, g, h, p, drop=()):
    """One tree over dense ``x``; every distinct non-zero value is a bin."""
    soft = lambda v: math.copysign(max(abs(v) - p.reg_alpha, 0), v)
    score = lambda a, b: soft(a) ** 2 / (b + p.reg_lambda)
    weights = np.zeros(len(x))

    def split(rows, depth):
        a, b = g[rows].sum(), h[rows].sum()
        best = None
        if depth < p.max_depth:
            for j in range(x.shape[1]):
                v = x[rows, j]
                for k, cut in enumerate(sorted(set(x[:, j][x[:, j] != 0]))):
                    for zeros_left in (False, True):
                        left = rows[np.where(v == 0, zeros_left, v <= cut)]
                        la, lb = g[left].sum(), h[left].sum()
                        if len(set(v[v != 0])) and min(lb, b - lb) >= p.min_child_weight - 1e-9 and 0 < len(left) < len(rows):
                            gain = round(score(la, lb) + score(a - la, b - lb) - score(a, b), 8)
                            if best is None or gain > best[0]:
                                best = (gain, j, k, zeros_left, left)
        if best is None or best[0] <= B.LEAST_GAIN or best[0] < p.gamma:
            weights[rows] = -p.learning_rate * soft(a) / (b + p.reg_lambda)
            return
        split(best[4], depth + 1)
        split(np.setdiff1d(rows, best[4]), depth + 1)

    split(np.arange(len(x)), 0)
    return weights


PENALTIES = [
    B.BoostParams(rounds=4, learning_rate=0.3, max_depth=3, reg_lambda=2.0, reg_alpha=0.5, gamma=0.2, min_child_weight=2.0),
    B.BoostParams(rounds=3, learning_rate=0.5, max_depth=2, reg_lambda=0.0, reg_alpha=0.0, min_child_weight=1.0),
    B.BoostParams(rounds=2, learning_rate=0.1, max_depth=4, reg_lambda=1.0, reg_alpha=2.0, min_child_weight=0.5),
]


@pytest.mark.parametrize("p", PENALTIES)
def test_rounds_equal_numpy(spark, p):
    m, x, y = table(spark, 1)
    model = B.fit(m, p)
    margin, losses = np.zeros(len(y)), []
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        margin = margin + numpy_round(x, q - y, q * (1 - q), p)
        losses.append(np.mean(np.log1p(np.exp(-margin * (2 * y - 1)))))
    got = {r.row_id: r.p for r in B.predict(model, m).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)), atol=1e-9)
    assert np.allclose([loss for _, part, loss in model.curve if part == "train"], losses, atol=1e-9)


def test_stops_after_patience_and_resumes(spark, tmp_path):
    m, _, _ = table(spark, 2, n=90)
    valid = m.rows.where("row_id % 3 = 0").select("row_id")
    p = B.BoostParams(rounds=30, learning_rate=1.5, max_depth=2, min_child_weight=0.5)
    model = B.fit(m, p, valid, patience=3, path=str(tmp_path / "whole"))
    assert len(model.trees) == model.best_rounds + 3 < 30
    losses = [loss for _, part, loss in model.curve if part == "valid"]
    assert min(range(len(losses)), key=losses.__getitem__) + 1 == model.best_rounds
    # Ended after two rounds, then taken up again: the same trees.
    again = str(tmp_path / "parts")
    B.fit(m, B.BoostParams(**{**p.__dict__, "rounds": 2}), valid, patience=3, path=again)
    resumed = B.fit(m, p, valid, patience=3, path=again)
    shape = lambda model: [(t.splits, {n: round(w, 9) for n, w in t.weights.items()}) for t in model.trees]
    assert shape(resumed) == shape(model) and resumed.best_rounds == model.best_rounds


def test_sampling_is_repeatable_and_partial(spark):
    m, _, _ = table(spark, 3)
    p = B.BoostParams(rounds=3, max_depth=2, subsample=0.6, colsample_bytree=0.4, min_child_weight=0.1)
    a, b = B.fit(m, p), B.fit(m, p)
    assert [t.splits for t in a.trees] == [t.splits for t in b.trees]
    assert len({s[0] for t in a.trees for s in t.splits.values()}) > 1


@pytest.mark.parametrize("name", sorted(XGB_PRESETS))
def test_every_preset_is_taken(spark, name, recwarn):
    p = B.BoostParams.preset(XGB_PRESETS[name], rounds=1, max_depth=2)
    m, _, _ = table(spark, 4, n=40, width=6)
    assert len(B.fit(m, p).trees) == 1 and not [w for w in recwarn if "penalty" in str(w.message)]


def test_values_not_seen_in_training(spark):
    m, _, _ = table(spark, 5)
    model = B.fit(m, B.BoostParams(rounds=2, max_depth=2))
    new = WideMatrix(
        entries=spark.createDataFrame([(1, "c2", 99.0), (2, "unknown", 1.0)], "row_id long, feature_id string, value double"),
        rows=spark.createDataFrame([(1,), (2,), (3,)], "row_id long"), label_col=None,
    )
    got = {r.row_id: r.p for r in B.predict(model, new).collect()}
    assert len(got) == 3 and got[2] == got[3] and all(0 < p < 1 for p in got.values())


def test_a_task_sends_summed_bins_not_cells(spark):
    import pyarrow as pa

    rows = 50
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0.5] * rows), pa.array([0.25] * rows), pa.array([[3, 7]] * rows, pa.list_(pa.int32())), pa.array([[0, 1]] * rows, pa.list_(pa.int32()))],
        names=["g", "h", "f", "b"],
    )
    sent = [b.to_pylist() for b in B._histograms(iter([batch]), B.Tree(), 0, 7, 4)]
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.int64) for r in sent[0]])
    sums = np.concatenate([np.frombuffer(r["g"]) for r in sent[0]])
    assert sorted(zip(keys.tolist(), sums.tolist())) == [(3 << 7, 25.0), (7 << 7 | 1, 25.0)]


def test_nodes_equal_the_expression(spark):
    rng = np.random.default_rng(9)
    tree = B.Tree(splits={1: (2, 0, False), 2: (0, 1, True), 3: (5, 0, True), 6: (1, 0, False)})
    cells = [sorted((int(j), int(rng.integers(0, 3))) for j in rng.choice(6, rng.integers(0, 6), replace=False)) for _ in range(80)] + [[(2, 0), (2, 1)]]
    df = spark.createDataFrame([(i, [j for j, _ in c], [b for _, b in c]) for i, c in enumerate(cells)], "row_id int, f array<int>, b array<int>")
    want = {r.row_id: r.n for r in df.select("row_id", B.node_of(tree).alias("n")).collect()}
    flat = [(j, b, i) for i, c in enumerate(cells) for j, b in c]
    f, b, owner = (np.array(x) for x in zip(*flat))
    assert B._nodes(tree, 3, f, b, owner, len(cells)).tolist() == [want[i] for i in range(len(cells))]


@pytest.mark.parametrize("ints", [(), (42, 7), (43, -3)])
def test_hashes_are_those_of_spark(spark, ints):
    from pyspark.sql import functions as F

    df = spark.range(50).select("id", F.col("id").cast("int").alias("i"))
    rows = df.select("id", F.xxhash64("id").alias("one"), F.xxhash64("id", *map(F.lit, ints)).alias("all"), F.xxhash64("i", *map(F.lit, ints)).alias("int")).collect()
    assert B._hashed(np.array([r.one for r in rows]), *ints).tolist() == [r["all"] for r in rows]
    assert B._hashed(np.full(50, 42), np.array([r.id for r in rows]), *ints).tolist() == [r["int"] for r in rows]


@pytest.mark.parametrize("changes", [dict(subsample=0.7, colsample_bytree=0.6, min_child_weight=2.0), dict(max_depth=5, min_child_weight=0.0)])
def test_whole_features_give_the_trees_of_rows(spark, monkeypatch, changes):
    m, _, _ = table(spark, 6, n=150)
    valid = m.rows.where("row_id % 4 = 0").select("row_id")
    p = B.BoostParams(**{**dict(rounds=4, learning_rate=0.4, max_depth=3, gamma=0.05, reg_alpha=0.1), **changes})
    monkeypatch.setattr(B.SB, "CHUNK_CELLS", 100)
    here = B.fit(m, p, valid)
    monkeypatch.setattr(B, "DRIVER_ROWS", 0)
    there = B.fit(m, p, valid)
    shape = lambda model: [(t.splits, {n: round(w, 9) for n, w in t.weights.items()}) for t in model.trees]
    assert shape(here) == shape(there)
    assert np.allclose([x[2] for x in here.curve], [x[2] for x in there.curve], atol=1e-9)


def test_a_level_shuffles_nothing(spark, monkeypatch):
    m, _, _ = table(spark, 7)
    monkeypatch.setattr(B, "_histograms", None)
    assert len(B.fit(m, B.BoostParams(rounds=2, max_depth=3)).trees) == 2


def test_null_labels_count_as_before(spark, monkeypatch):
    from pyspark.sql import functions as F

    m, _, _ = table(spark, 8)
    m = WideMatrix(m.entries, m.rows.withColumn("label", F.when(F.col("row_id") % 7 != 0, F.col("label"))))
    valid = m.rows.where("row_id % 4 = 0").select("row_id")
    p = B.BoostParams(rounds=3, max_depth=3, min_child_weight=0.5)
    here = B.fit(m, p, valid)
    monkeypatch.setattr(B, "DRIVER_ROWS", 0)
    there = B.fit(m, p, valid)
    assert [t.splits for t in here.trees] == [t.splits for t in there.trees] and here.trees[0].splits
    assert np.allclose([x[2] for x in here.curve], [x[2] for x in there.curve], atol=1e-9)
