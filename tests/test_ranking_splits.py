import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from featsift.operators import ranking as RK
from featsift.operators import split as SP


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 50), rnd.random()) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, g int, x double").repartition(7)


def test_sequence_by_equals_row_number(data):
    got = {r.id: r.rn for r in RK.sequence_by(data, ["g", "id"], "rn").collect()}
    ref = {r.id: r.rn for r in data.withColumn("rn", F.row_number().over(Window.orderBy("g", "id"))).collect()}
    assert got == ref


def test_running_sums(data):
    got = {r.id: (r.cx, r.rn) for r in RK.running_sums(data, ["g", "id"], {"cx": "x"}, rn="rn").collect()}
    w = Window.orderBy("g", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = {r.id: (r.cx, r.rn) for r in data.select("id", F.sum("x").over(w).alias("cx"),
                                                    F.row_number().over(Window.orderBy("g", "id")).alias("rn")).collect()}
    for k, (cx, rn) in ref.items():
        assert got[k][1] == rn and got[k][0] == pytest.approx(cx)


def test_top_k_small_and_large_paths_agree(data):
    order = [F.col("x").desc(), F.col("id")]
    small = [r.id for r in RK.top_k(data, 1000, order).orderBy("rank").collect()]
    big = [r.id for r in RK.sequence_by(data, order, "rank").where("rank <= 1000").orderBy("rank").collect()]
    assert small == big
    large = RK.top_k(data, 1500, order)
    assert large.count() == 1500


def test_split_random_exact_and_disjoint(spark, data):
    s = SP.split_random(data.select(F.col("id").alias("row_id")), 0.15, 42)
    n_test = s.where("split = 'test'").count()
    assert n_test == 300  # ceil(0.15 * 2000)
    assert s.select("row_id").distinct().count() == 2000


def test_stratified_quotas_and_ratio(spark, data):
    rows = data.select(F.col("id").alias("row_id"), (F.col("g") < 10).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    quota = SP.stratified_quotas(counts, 0.2)
    assert sum(quota.values()) == 400
    s = SP.split_stratified(rows, "label", 0.2, 42)
    got = {r[0]: r[1] for r in s.where("split = 'test'").groupBy("label").count().collect()}
    assert got == quota
    three = SP.split_three_way(rows, "label", 42)
    sizes = {r[0]: r[1] for r in three.groupBy("split").count().collect()}
    assert sizes["train"] + sizes["valid"] + sizes["test"] == 2000
    assert sizes["train"] == 1200


def test_stratified_quota_example():
    assert SP.stratified_quotas({0: 348, 1: 51}, 0.2) == {0: 70, 1: 10}


def test_hash_split_is_shuffle_free_and_close(spark, data):
    rows = data.select(F.col("id").alias("row_id"))
    s = SP.split_random(rows, 0.2, 42, exact=False)
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(s) == exchanges(rows)  # the split adds no shuffle
    n_test = s.where("split = 'test'").count()
    assert abs(n_test - 400) < 80
    again = {r.row_id: r.split for r in SP.split_random(rows, 0.2, 42, exact=False).collect()}
    assert again == {r.row_id: r.split for r in s.collect()}
