import numpy as np
import pytest
from pyspark.sql import functions as F

from featsift.operators import models as MD
from featsift.operators import reduce as RD
from featsift.operators import scale as SCL
from featsift.plans import pipelines as PL
from featsift.sources import tables as T
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    cfg = PL.ScreeningConfig("chi2", 200, model="logreg", model_params={"max_iter": 100})
    return PL.fit_screening(T.token_matrix(spark, SF_SMALL), cfg)


def test_screening_scores_every_test_row(spark, fitted):
    test = T.token_matrix(spark, SF_SMALL, "unlabelled", with_columns=False)
    scored = PL.transform_screening(fitted, test)
    assert scored.count() == test.rows.count()
    again = {r.row_id: r.p for r in PL.transform_screening(fitted, test).collect()}
    first = {r.row_id: r.p for r in scored.collect()}
    assert again == first  # deterministic replay


def test_train_accuracy_beats_majority(spark, fitted):
    train = T.token_matrix(spark, SF_SMALL)
    scored = PL.transform_screening(fitted, train).join(train.rows, "row_id")
    acc = scored.agg(F.avg((F.col("label") == F.col("label_pred")).cast("double"))).first()[0]
    majority = train.rows.agg(F.avg("label")).first()[0]
    assert acc >= max(majority, 1 - majority)


def test_stream_scoring_matches_batch(spark, fitted, tmp_path):
    src = str(tmp_path / "docs")
    test_docs = T.table(spark, SF_SMALL, "documents").join(T.table(spark, SF_SMALL, "labels"), "doc_id", "left_anti")
    test_docs.repartition(3).write.parquet(src)
    from featsift.streaming.scoring import score_documents_stream

    q = score_documents_stream(spark, fitted, src, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                               max_files_per_trigger=1)
    q.awaitTermination(300)
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    got = {int(r.id): int(r.label) for r in out.collect()}
    test = T.token_matrix(spark, SF_SMALL, "unlabelled", with_columns=False)
    batch = {r.id: r.label for r in PL.submission_frame(PL.transform_screening(fitted, test)).collect()}
    assert got == batch


def test_population_scaler(spark):
    from pyspark.ml.functions import array_to_vector

    emb = T.table(spark, SF_SMALL, "embeddings").select(
        F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    z = SCL.PopulationScaler(center=True).fit(emb).transform(emb)
    X = np.array([r.features.toArray() for r in z.collect()])
    assert np.allclose(X.mean(axis=0), 0, atol=1e-9) and np.allclose(X.var(axis=0), 1, atol=1e-9)
    s = SCL.PopulationScaler(center=False).fit(emb).transform(emb)
    X2 = np.array([r.features.toArray() for r in s.orderBy("row_id").collect()])
    raw = np.array([r.features.toArray() for r in emb.orderBy("row_id").collect()])
    assert np.allclose(X2, raw / raw.std(axis=0))


def test_pca_matches_svd(spark):
    from pyspark.ml.functions import array_to_vector

    emb = T.table(spark, SF_SMALL, "embeddings").select(
        F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    fit = RD.pca_fit(emb, 5)
    V = fit.model.pc.toArray()
    assert np.allclose(V.T @ V, np.eye(5), atol=1e-8)
    X = np.array([r.features.toArray() for r in emb.orderBy("row_id").collect()])
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    for i in range(5):
        assert abs(abs(vt[i] @ V[:, i]) - 1) < 1e-6
    proj = np.array([r.features.toArray() for r in RD.pca_project(emb, fit).orderBy("row_id").collect()])
    assert np.allclose(proj, Xc @ V, atol=1e-8)


def test_best_round_patience():
    assert MD.best_round([5, 4, 3, 3.5, 3.2, 3.1, 2.9], 3) == 3
    assert MD.best_round([5, 4, 3, 3.5, 3.2, 2.9], 3) == 6


def test_gbt_mapping_warns():
    with pytest.warns(UserWarning):
        est = MD.gbt_from_xgb(MD.XGB_PRESETS["tall_3000"])
    assert est.getMaxIter() == 3000 and est.getMaxDepth() == 8 and est.getFeatureSubsetStrategy() == "0.8"


def test_prefix_value_constancy_chain(spark):
    """P1 -> A4 -> gather -> scale -> logistic regression, wide (sparse vectors, scale only)."""
    cfg = PL.ScreeningConfig(None, 0, prefix=6000, drop_constant_by_value=True, model="logreg",
                             model_params={"max_iter": 50})
    train = T.token_matrix(spark, SF_SMALL)
    fitted = PL.fit_screening(train, cfg)
    assert fitted.width > 4096  # exercises the sparse vector path
    test = T.token_matrix(spark, SF_SMALL, "unlabelled", with_columns=False)
    assert PL.transform_screening(fitted, test).count() == test.rows.count()


def test_cli_writes_submission(spark, tmp_path):
    from featsift.plans import run

    out = str(tmp_path / "sub")
    run.main(["--tables", SF_SMALL, "--out", out, "--chain", "screen-logreg", "--k", "100"])
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["id", "label"]
    assert back.count() == T.token_matrix(spark, SF_SMALL, "unlabelled", with_columns=False).rows.count()


@pytest.mark.parametrize("model,params", [("forest", {"num_trees": 10, "max_depth": 5}),
                                          ("gbt", {"n_estimators": 5, "max_depth": 3, "subsample": 0.8})])
def test_models_deterministic_under_seed(spark, model, params):
    train = T.token_matrix(spark, SF_SMALL)
    test = T.token_matrix(spark, SF_SMALL, "unlabelled", with_columns=False)
    runs = []
    for _ in range(2):
        fitted = PL.fit_screening(train, PL.ScreeningConfig("anova_f", 200, model=model, model_params=params, seed=7))
        runs.append({r.row_id: r.p for r in PL.transform_screening(fitted, test).collect()})
    assert runs[0] == runs[1]
