import numpy as np
import pytest
from pyspark.sql import functions as F

from featsift.sources import archive, sinks
from featsift.sources import tables as T
from featsift.sources.metadata import read_metadata_csv
from tests.conftest import SF_SMALL


def test_npz_ingest_matches_table(spark, tmp_path):
    emb = T.table(spark, SF_SMALL, "embeddings").orderBy("vec_id").toPandas()
    X = np.stack(emb["embedding"].to_numpy()).astype(np.float32)
    y = emb["label"].to_numpy().astype(np.int64)
    ids = np.array([f"v{i}" for i in emb["vec_id"]], dtype="<U8")
    path = str(tmp_path / "train.npz")
    np.savez_compressed(path, X_train=X, y_train=y, ids=ids)
    entries, rows = archive.ingest_archive(spark, path, rows_per_partition=64)
    got = {(r.row_id, r.feature_id): r.value for r in entries.collect()}
    nz = np.nonzero(X)
    assert len(got) == len(nz[0])
    assert got[(3, 5)] == pytest.approx(float(X[3, 5]))
    r = {x.row_id: (x.id, x.label) for x in rows.collect()}
    assert r[0] == ("v" + str(emb["vec_id"][0]), int(y[0])) and len(r) == len(y)


def test_npy_rejects_object_arrays(spark, tmp_path):
    path = str(tmp_path / "obj.npy")
    np.save(path, np.array([{"a": 1}, None], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        archive._header(path, None)


def test_metadata_csv_na_tokens(spark, tmp_path):
    p = tmp_path / "meta.csv"
    p.write_text("ID,Organism group,Create date,Unnamed: 0,kind\n1,x,2020,0,NA\n2,y,2021,1,n/a\n3,z,2022,2,foo\n4,w,2023,3,\n")
    df = read_metadata_csv(spark, str(p), key="ID", key_type="bigint")
    from featsift.operators.encode import clean_metadata, fill_missing

    clean = fill_missing(clean_metadata(df), ["kind"])
    assert clean.columns == ["ID", "kind"]
    assert {r.ID: r.kind for r in clean.collect()} == {1: "Missing", 2: "Missing", 3: "foo", 4: "Missing"}


def test_reduced_sink_roundtrip(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    emb = T.table(spark, SF_SMALL, "embeddings").select(
        F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    sinks.write_reduced(emb, str(tmp_path / "red"))
    back = sinks.read_reduced(spark, str(tmp_path / "red"))
    assert back.count() == emb.count()
    a = {r.row_id: r.features for r in emb.collect()}
    for r in back.collect():
        assert np.allclose(a[r.row_id].toArray(), r.features.toArray())


def test_submission_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    sinks.write_submission(df, str(tmp_path / "sub"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sub"))
    assert back.columns == ["id", "label"] and back.count() == 2


def test_npy_rejects_nan(spark, tmp_path):
    path = str(tmp_path / "nan.npz")
    X = np.ones((5, 3))
    X[2, 1] = np.nan
    np.savez(path, X_train=X)
    entries, _ = archive.ingest_archive(spark, path, labels=None, ids=None)
    with pytest.raises(Exception):
        entries.collect()


def test_assert_finite(spark, f6):
    from featsift.operators.matrix import WideMatrix
    from featsift.operators.stats import assert_finite

    assert_finite(f6)
    bad = f6.entries.limit(1).withColumn("value", F.lit(float("nan")))
    with pytest.raises(ValueError):
        assert_finite(WideMatrix(entries=f6.entries.unionByName(bad), rows=f6.rows))


def test_stored_matrix_prefix_pushdown(spark, tmp_path):
    from featsift.operators import matrix as MX
    from featsift.operators import scores as SC

    emb = T.table(spark, SF_SMALL, "embeddings").orderBy("vec_id").toPandas()
    X = np.stack(emb["embedding"].to_numpy()).astype(np.float64)
    y = (emb["label"].to_numpy() < 5).astype(np.int64)
    path = str(tmp_path / "arch.npz")
    np.savez(path, X_train=X, y_train=y, ids=np.arange(len(y)))
    out = str(tmp_path / "store")
    archive.ingest_archive(spark, path, out=out)
    m = archive.read_matrix(spark, out)
    cut = MX.prefix_features(MX.WideMatrix(entries=m.entries, rows=m.rows,
                                           columns=spark.range(64).select(F.col("id").alias("feature_id"))), 10)
    plan = cut.entries._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(feature_id,9)" in plan
    assert cut.entries.select("feature_id").distinct().count() == 10
    # Scores from the stored form equal scores from the table form.
    f_store = {r.feature_id: r.f_score for r in SC.anova_f(m).collect()}
    f_table = {r.feature_id: r.f_score for r in SC.anova_f(T.embedding_matrix(spark, SF_SMALL, binary=True)).collect()}
    assert all(abs(f_store[k] - f_table[k]) <= 1e-9 * max(1.0, abs(f_table[k])) for k in f_table)
