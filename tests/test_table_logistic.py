"""Logistic regression with a table of coefficients, and joins that keep hot columns apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsift.operators import hot as H
from featsift.operators import models as MD
from featsift.operators import table_logistic as TL
from featsift.operators.matrix import WideMatrix, drop_features, gather, to_vectors
from featsift.session import scratch_path


def sparse(spark, n=300, d=40, seed=3, density=0.2):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, d)) < density) * rng.normal(size=(n, d)).round(3)
    w = rng.normal(size=d) * 2
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ w + 0.5)))).astype(int)
    cells = [(int(i), f"c{j:04d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    entries = spark.createDataFrame(cells, "row_id long, feature_id string, value double")
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, label int")
    columns = spark.createDataFrame([(f"c{j:04d}",) for j in range(d + 1)], "feature_id string")  # one without cells
    return WideMatrix(entries, rows, columns), x, y


def objective(x, y, w, b, c):
    z = x @ w + b
    return (np.logaddexp(0, z) - y * z).mean() + w @ w / (2 * c * len(y))


def weights_of(model):
    return {r.feature_id: r.weight for r in model.coefficients.collect()}


@pytest.mark.parametrize("c", [0.2])
def test_gradient_is_zero_at_the_coefficients(spark, c):
    m, x, y = sparse(spark)
    model = TL.fit(m, c=c, tol=1e-6)
    got = weights_of(model)
    w = np.array([got[f"c{j:04d}"] for j in range(x.shape[1])])
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert model.converged
    assert np.abs(x.T @ (p - y) / len(y) + w / (c * len(y))).max() < 2e-6
    assert abs((p - y).mean()) < 2e-6
    assert abs(model.objective - objective(x, y, w, model.intercept, c)) < 1e-8
    assert got["c0040"] == 0.0


def test_same_coefficients_as_spark_ml_on_many_columns(spark):
    m, x, y = sparse(spark, n=400, d=1000, density=0.02)
    model = TL.fit(m, tol=1e-6)
    index = m.columns.select("feature_id", F.substring("feature_id", 2, 9).cast("int").alias("new_index"))
    vectors = to_vectors(gather(m, index, bound_rows=1001), 1001)
    ours = MD.logistic_regression(400, tol=1e-12).fit(vectors)
    got = weights_of(model)
    assert np.abs(np.array([got[f"c{j:04d}"] for j in range(1001)]) - ours.coefficients.toArray()).max() < 1e-3
    assert abs(model.intercept - ours.intercept) < 1e-3


def test_a_fit_goes_on_from_its_last_state(spark):
    m, x, y = sparse(spark, n=60, d=5)
    path = scratch_path(spark, "resume")
    first = TL.fit(m, max_iter=3, tol=1e-6, path=path)
    assert first.steps == 3 and not first.converged
    second = TL.fit(m, max_iter=60, tol=1e-6, path=path)
    whole = TL.fit(m, max_iter=60, tol=1e-6)
    assert second.converged and second.steps == whole.steps
    a, b = weights_of(second), weights_of(whole)
    assert max(abs(a[k] - b[k]) for k in b) < 1e-9


def test_wide_tables_join_the_same_way(spark, monkeypatch):
    m, x, y = sparse(spark, n=60, d=5)
    narrow = TL.fit(m, tol=1e-6)
    monkeypatch.setattr(TL, "BROADCAST_ROWS", 3)
    wide = TL.fit(m, tol=1e-6)
    a, b = weights_of(narrow), weights_of(wide)
    assert max(abs(a[k] - b[k]) for k in b) < 1e-4
    p = {r.row_id: r.p for r in TL.predict(wide, m).collect()}
    w = np.array([b[f"c{j:04d}"] for j in range(x.shape[1])])
    assert np.allclose([p[i] for i in range(len(y))], 1 / (1 + np.exp(-(x @ w + wide.intercept))))


def test_labels_of_a_fit(spark):
    m, _, _ = sparse(spark, n=20, d=4)
    with pytest.raises(ValueError):
        TL.fit(WideMatrix(m.entries, m.rows.withColumn("label", F.lit(2))))
    with pytest.raises(ValueError):
        TL.fit(WideMatrix(m.entries, m.rows.withColumn("label", F.lit(None).cast("int"))))
    with pytest.raises(ValueError):
        TL.fit(WideMatrix(m.entries, m.rows.limit(0)))
    one_class = TL.fit(WideMatrix(m.entries, m.rows.withColumn("label", F.lit(1))), max_iter=5)
    assert one_class.intercept > 0


# ---------------------------------------------------------------- hot columns


def crowded(spark, docs=4000):
    """One token in every document, the others rare; a null now and then."""
    return spark.range(docs).select(
        F.col("id").alias("row_id"),
        F.explode(F.array(F.lit("the"), F.concat(F.lit("t"), F.col("id").cast("string")), F.when(F.col("id") % 50 == 0, None).otherwise(
            F.concat(F.lit("u"), (F.col("id") % 400).cast("string"))))).alias("feature_id"),
        F.lit(1.0).alias("value"),
    )


def test_sketch_finds_every_hot_key(spark):
    rows = crowded(spark)
    assert {r[0] for r in H.hot_keys(rows, "feature_id", 0.01).collect()} == {"the"}
    found = {r[0] for r in H.hot_keys(rows, "feature_id", 1 / 2000).collect()}
    assert {"the"} <= found and len(found) <= 401
    assert H.hot_keys(rows.limit(0), "feature_id", 0.01).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_apart_equals_the_plain_join(spark, how):
    rows = crowded(spark)
    fitted = rows.where("feature_id = 'the' OR feature_id LIKE 't1%'").select("feature_id").distinct().withColumn("k", F.length("feature_id"))
    got, want = H.join_apart(rows, fitted, "feature_id", how), rows.join(fitted, "feature_id", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_task_gets_the_hot_column(spark):
    """The rows that the shuffle deals: no partition over twice the median."""
    rows = crowded(spark, 20_000)
    hot = H.hot_keys(rows, "feature_id")
    rest = rows.where("feature_id IS NOT NULL").join(F.broadcast(hot), "feature_id", "left_anti")

    def spread(df):
        sizes = [r["count"] for r in df.repartition(8, "feature_id").groupBy(F.spark_partition_id()).count().collect()]
        return max(sizes) / np.median(sizes)

    assert spread(rows) > 2 > spread(rest)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dropped = rows.select("feature_id").distinct().where("feature_id LIKE '%7'")
        plan = H.join_apart(rows, dropped, "feature_id", "left_anti", hot)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "strategy=broadcast" in plan and plan.count("Union") >= 1


def test_dropped_columns_leave_whether_hot_or_not(spark):
    rows = crowded(spark, 500)
    m = WideMatrix(rows, spark.range(500).withColumnRenamed("id", "row_id"), None, None)
    gone = spark.createDataFrame([("the",), ("t7",)], "feature_id string")
    left = drop_features(m, gone).entries
    assert left.where("feature_id IN ('the', 't7')").count() == 0
    assert left.count() == rows.count() - 501


# ---------------------------------------------------------------- blocks of rows


def test_an_evaluation_sends_blocks_not_cells(spark):
    """Sums of an evaluation: the loss and gradient of numpy, over several blocks, with
    repeated and null row ids; what is sent is one number a block, not one a cell."""
    rng = np.random.default_rng(5)
    cells = [(r, n, float(v), float(r % 2)) for r in range(40) for n, v in zip(range(0, 6), [1.0, *rng.normal(size=5)])]
    cells += [(None, 0, 1.0, 0.0), (None, 0, 1.0, 1.0), (3, 0, 1.0, 0.0), (3, 2, None, 0.0)]
    df = spark.createDataFrame(cells, "row_id long, number long, value double, label double").repartition(2, "row_id").sortWithinPartitions("row_id")
    stored = df.mapInArrow(lambda it: TL._blocks(it, 25), TL._BLOCKS).collect()
    blocks = spark.createDataFrame(stored, TL._BLOCKS)
    needs = spark.createDataFrame([(b.block, i, n) for b in stored for i, n in enumerate(b.numbers)], "block long, code int, number long")
    assert len(stored) > 2 and needs.count() < len(cells) / 2
    w, d = rng.normal(size=6), rng.normal(size=6)
    weights = spark.createDataFrame([(i, float(w[i]), float(d[i])) for i in range(6)], "number long, w double, d double")
    got = dict(TL._evaluate(blocks.drop("numbers"), needs, weights, 6).collect())
    zw, zd = {}, {}
    for r, n, v, _ in cells:
        zw[r], zd[r] = zw.get(r, 0) + (v or 0) * w[n], zd.get(r, 0) + (v or 0) * d[n]
    for i, t in enumerate((0.0, *TL.STEPS)):
        z = [(zw[r] + t * zd[r], y) for r, n, _, y in cells if n == 0]
        assert abs(got[-1 - i] - sum(np.logaddexp(0, m) - y * m for m, y in z)) < 1e-9
    for j in range(6):
        assert abs(got[j] - sum((v or 0) * (1 / (1 + np.exp(-zw[r] - zd[r])) - y) for r, n, v, y in cells if n == j)) < 1e-9


def test_a_fit_reads_no_window_over_cells(spark, monkeypatch):
    plans, evaluate = [], TL._evaluate

    def seen(*args):
        out = evaluate(*args)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(TL, "_evaluate", seen)
    TL.fit(sparse(spark, n=30, d=4)[0], max_iter=1)
    assert plans and all("Window" not in x and "CoGroup" in x for x in plans)


def test_evaluations_of_held_weights_join_nothing(spark, monkeypatch):
    m, x, y = sparse(spark, n=60, d=5)
    want = weights_of(TL.fit(m, tol=1e-6))
    evaluate, calls = TL._evaluate, []
    monkeypatch.setattr(TL, "_evaluate", lambda *args: calls.append(1) or evaluate(*args))
    monkeypatch.setattr(TL, "BLOCK_CELLS", 20)
    monkeypatch.setattr(TL, "WRITTEN", 2)
    path = scratch_path(spark, "held")
    model = TL.fit(m, tol=1e-6, path=path)
    got = weights_of(model)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert len(calls) == 1 < model.steps  # the first state
    states = [k for k in range(model.steps + 1) if TL._read(spark, f"{path}/state-{k}") is not None]
    assert states == [model.steps]  # older ones are gone


def test_other_models_score_after_a_fit(spark, monkeypatch):
    monkeypatch.setattr(TL, "BROADCAST_ROWS", 3)  # every state is a table
    m, x, y = sparse(spark, n=40, d=4)
    TL.fit(m, max_iter=2)
    index = m.columns.select("feature_id", F.substring("feature_id", 2, 9).cast("int").alias("new_index"))
    vectors = to_vectors(gather(m, index, bound_rows=5), 5)
    model = MD.logistic_regression(40, max_iter=5).fit(vectors)
    assert MD.score(model, vectors, ["row_id"]).count() == len(MD.score(model, vectors, ["row_id"]).collect()) == 40
