import math

import pytest
from pyspark.sql import functions as F

from featsift.operators import encode as EN
from featsift.operators import metrics as ME


@pytest.fixture(scope="module")
def cats(spark):
    vals = ["A"] * 50 + ["B"] * 10 + [f"r{i}" for i in range(40)]
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "ID long, c string")


def test_top2_first_fit_and_refit(spark, cats):
    top = EN.fit_top_categories(cats, ["c"], 2)
    assert [r.value for r in top.orderBy("rank").collect()] == ["A", "B"]
    test = spark.createDataFrame([(1, "A"), (2, "B"), (3, "Z"), (4, None)], "ID long, c string")
    first = {r.ID: r.c for r in EN.collapse_rare(test, ["c"], top).collect()}
    assert first == {1: "A", 2: "B", 3: "Other", 4: "Other"}
    _, refit = EN.collapse_rare_refit(cats, test, ["c"], 2)
    assert {r.ID: r.c for r in refit.collect()} == {1: "A", 2: "Other", 3: "Other", 4: "Other"}


def test_missing_can_be_top(spark):
    df = spark.createDataFrame([(i, None if i < 5 else ("x" if i < 8 else "y")) for i in range(9)], "ID long, c string")
    filled = EN.fill_missing(df, ["c"])
    top = EN.fit_top_categories(filled, ["c"], 2)
    assert [r.value for r in top.orderBy("rank").collect()] == ["Missing", "x"]


def test_one_hot_frame_and_alignment(spark):
    tr = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ID long, c string")
    te = spark.createDataFrame([(4, "a"), (5, "z")], "ID long, c string")
    d_tr, d_te = EN.dummy_dictionary(tr, ["c"]), EN.dummy_dictionary(te, ["c"])
    frame = EN.one_hot_frame(tr, ["c"], d_tr)
    assert frame.columns == ["ID", "c_a", "c_b"]
    assert {r.ID: (r.c_a, r.c_b) for r in frame.collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 0)}
    outer = {r.feature_id: (r.in_train, r.in_test) for r in EN.align_outer(d_tr, d_te).collect()}
    assert outer == {"c_a": (True, True), "c_b": (True, False), "c_z": (False, True)}
    aligned = EN.align_to_train(EN.one_hot_long(te, ["c"]), d_tr)
    assert [(r.row_id, r.feature_id) for r in aligned.collect()] == [(4, "c_a")]


def test_target_encoding_count_and_sigmoid(spark):
    tr = spark.createDataFrame([(1, "c1", 1), (2, "c1", 0), (3, "c1", 1), (4, "c2", 0)], "ID long, c string, label int")
    te = spark.createDataFrame([(5, "c1"), (6, "c2"), (7, "c9")], "ID long, c string")
    cnt = EN.apply_target_encoder(te, ["c"], EN.fit_target_encoder(tr, ["c"], weighting="count", smoothing=10))
    got = {r.ID: r.c for r in cnt.collect()}
    assert got[5] == pytest.approx(7 / 13) and got[6] == pytest.approx(5 / 11) and got[7] == pytest.approx(0.5)
    sig = EN.apply_target_encoder(te, ["c"], EN.fit_target_encoder(tr, ["c"], weighting="sigmoid", smoothing=10))
    got = {r.ID: r.c for r in sig.collect()}
    w = 1 / (1 + math.exp(-(3 - 20) / 10))
    assert got[5] == pytest.approx(0.5 * (1 - w) + (2 / 3) * w)
    assert got[6] == pytest.approx(0.5)  # seen once -> prior
    assert got[7] == pytest.approx(0.5)


def test_metrics_fixture(spark):
    df = spark.createDataFrame([(0.7, 1), (0.5, 0), (1.0, 0)], "p double, label int")
    assert ME.log_loss(df, "label", "p").first()[0] == pytest.approx(11.862866, abs=1e-5)
    acc = ME.accuracy(df.withColumn("prediction", (F.col("p") > 0.5).cast("int")), "label")
    assert acc.first()[0] == pytest.approx(2 / 3)
    assert ME.roc_auc(df, "label", "p").first()[0] == pytest.approx(0.5)


def test_auc_with_ties_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = [(float(rnd.randint(0, 5)), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p double, label int")
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    brute = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert ME.roc_auc(df, "label", "p").first()[0] == pytest.approx(brute)
