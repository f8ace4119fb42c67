"""End-to-end pipelines: fit on train, replay on new rows, write ``(id, label)``.

Each fitted state is small (selected columns, scaler arrays, a model) and every
replay is a join + projection + ``model.transform``: Spark partitions replace
the reference's 10,000-row scoring chunks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsift.operators import encode as EN
from featsift.operators import matrix as MX
from featsift.operators import models as MD
from featsift.operators import randomized_pca as RP
from featsift.operators import reduce as RD
from featsift.operators import scale as SCL
from featsift.operators import select as SE
from featsift.operators import split as SP
from featsift.operators import stats as ST
from featsift.operators.hot import join_apart
from featsift.operators.scores import SCORERS
from featsift.session import pin, shuffles_removed
from featsift.sources import tables as T


@dataclass
class ScreeningConfig:
    scorer: str | None = "chi2"  # None: keep every non-constant column
    k: int = 500
    layout: str = "rank"
    prefix: int | None = None  # P1 before anything else
    drop_constant_eps: float | None = None  # A3 before scoring (std > eps)
    drop_constant_by_value: bool = False  # A4 before scoring (exact, zero-aware)
    scale: bool = True
    center: bool = False  # also subtract the mean (makes sparse vectors dense)
    fit_on: str = "train"  # with a hold-out: fit selection and scaler on its train part, or on "all" labelled rows
    model: str = "logreg"  # logreg | forest | gbt
    model_params: dict = field(default_factory=dict)
    holdout: float | None = None  # K1 split of train, used for early stopping / eval log
    patience: int | None = None
    seed: int = 42


@dataclass
class FittedScreening:
    selected: DataFrame
    width: int
    scaler: Any
    model: Any
    curve: list = field(default_factory=list)
    best_rounds: int | None = None


def _vectors(m: MX.WideMatrix, fitted_sel: DataFrame, width: int, scaler=None) -> DataFrame:
    g = MX.gather(m, fitted_sel, bound_rows=width)
    v = MX.to_vectors(g, width)
    return scaler.transform(v) if scaler is not None else v


def rows_of(m: MX.WideMatrix, rows: DataFrame) -> MX.WideMatrix:
    """The matrix restricted to ``rows(row_id)``: same columns, fewer rows.  Cells of
    the other rows leave; the single-scan source is given up for the entries."""
    keep = rows.select("row_id")
    return MX.WideMatrix(
        entries=m.entries.join(keep, "row_id", "left_semi"), rows=m.rows.join(keep, "row_id", "left_semi"),
        columns=m.columns, label_col=m.label_col,
    )


def fit_screening(train: MX.WideMatrix, cfg: ScreeningConfig) -> FittedScreening:
    m, parts = train, None
    if cfg.holdout:
        parts = pin(SP.split_random(train.rows.select("row_id"), cfg.holdout, cfg.seed))
        if cfg.fit_on == "train":
            m = rows_of(train, parts.where(F.col("split") == "train"))
    if cfg.prefix:
        m = MX.prefix_features(m, cfg.prefix)
    if cfg.drop_constant_eps is not None or cfg.drop_constant_by_value:
        if cfg.drop_constant_by_value:
            kept = ST.constant_by_value(m).where(~F.col("is_constant")).select("feature_id")
        else:
            kept = ST.nonconstant_features(m, cfg.drop_constant_eps)
        m = MX.WideMatrix(
            entries=join_apart(m.entries, kept, "feature_id", "left_semi"), rows=m.rows, columns=kept, label_col=m.label_col
        )
    if cfg.scorer:
        selected = SE.select_top_k(SCORERS[cfg.scorer](m), cfg.k, "score", cfg.layout)
    else:
        selected = SE.nonconstant_selection(m.feature_spine())
    selected = pin(selected.select("feature_id", "new_index"))
    width = selected.count()
    if width == 0:
        raise ValueError("no column selected")
    # Vectors of all labelled rows, built once: the scaler reads the fitted part of them.
    raw = _vectors(train, selected, width, None).persist(StorageLevel.MEMORY_AND_DISK)
    base = raw
    if parts is not None and cfg.fit_on == "train":
        base = raw.join(parts.where(F.col("split") == "train").select("row_id"), "row_id", "left_semi")
    scaler = SCL.PopulationScaler(center=cfg.center).fit(base) if cfg.scale else None
    vec = (scaler.transform(raw) if scaler is not None else raw).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = FittedScreening(selected=selected, width=width, scaler=scaler, model=None)
    train_part, valid_part = vec, None
    if parts is not None:
        part_of = lambda name: parts.where(F.col("split") == name).select("row_id")
        train_part = vec.join(part_of("train"), "row_id", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
        valid_part = vec.join(part_of("test"), "row_id", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    if cfg.model == "logreg":
        n_train = train_part.count()
        part = train_part
        if width <= MX.DENSE_MAX_WIDTH:
            part = MD.right_size(train_part, n_train, width).persist(StorageLevel.MEMORY_AND_DISK)
        fitted.model = MD.logistic_regression(n_train, **cfg.model_params).fit(part)
        if part is not train_part:
            part.unpersist()
    elif cfg.model == "forest":
        fitted.model = MD.random_forest(**{"seed": cfg.seed, **cfg.model_params}).fit(train_part)
    elif cfg.model == "gbt":
        est = MD.SparseBoosting(MD.gbt_from_xgb(cfg.model_params, seed=cfg.seed))
        if valid_part is not None and cfg.patience:
            res = MD.fit_early_stopping(est, train_part, valid_part, cfg.patience)
            fitted.model, fitted.curve, fitted.best_rounds = res.model, res.curve, res.best_rounds
        else:
            fitted.model, fitted.curve = est.watched(train_part, valid_part)
    else:
        raise ValueError(cfg.model)
    return fitted


def transform_screening(fitted: FittedScreening, m: MX.WideMatrix) -> DataFrame:
    """Gather -> vectors -> scale -> predict for any rows (no chunk loop)."""
    vec = _vectors(m, fitted.selected, fitted.width, fitted.scaler)
    return MD.score(fitted.model, vec, ["row_id"])


def submission_frame(scored: DataFrame) -> DataFrame:
    """``(id, label)`` with an integer label."""
    return scored.select(F.col("row_id").alias("id"), F.col("label_pred").cast("int").alias("label"))


from featsift.sources.sinks import write_submission  # noqa: E402,F401


def screening_submission(spark: SparkSession, sf_dir: str, cfg: ScreeningConfig | None = None) -> DataFrame:
    """Flagship: token matrix -> chi2 -> top-k -> scale -> logistic regression -> (id, label)."""
    cfg = cfg or ScreeningConfig(scorer="chi2", k=500, model="logreg", model_params={"max_iter": 1000})
    train = T.token_matrix(spark, sf_dir, "labelled")
    test = T.token_matrix(spark, sf_dir, "unlabelled", with_columns=False)
    fitted = fit_screening(train, cfg)
    return submission_frame(transform_screening(fitted, test))


# ---------------------------------------------------------------- reduced matrix + metadata


def reduced_tokens(spark: SparkSession, sf_dir: str, k_tokens: int | None = None, k_pca: int = 250, seed: int = 42,
                   fit_rows: DataFrame | None = None):
    """The reduced matrix: PCA of the token matrix, projected for labelled and
    unlabelled rows (D1 + D2); (train, test, width).  Every column takes part
    (wide PCA), or with ``k_tokens`` the chi2-selected ones (narrow PCA).  Selection
    and axes are fitted on ``fit_rows(row_id)`` (default: all labelled rows); give
    the train part of a split so that the labels of held-out rows are never read."""
    train = T.token_matrix(spark, sf_dir, "labelled")
    seen = train if fit_rows is None else rows_of(train, fit_rows)
    test = T.token_matrix(spark, sf_dir, "unlabelled", with_columns=False)
    if k_tokens is None:
        spine = replace(seen, columns=seen.entries.select("feature_id").distinct(), scan=None)
        fit = RP.fit(spine, k_pca, seed=seed)
        vectors = lambda m: RP.project(m, fit).select("row_id", array_to_vector("pcs").alias("features"))
        with shuffles_removed(spark):
            reduced = pin(train.rows.join(vectors(train), "row_id"))  # read several times
        return reduced, vectors(test), fit.k
    sel = pin(SE.select_top_k(SCORERS["chi2"](seen), k_tokens, "score", "rank").select("feature_id", "new_index"))
    width = sel.count()
    tr_v = _vectors(train, sel, width, None)
    te_v = _vectors(test, sel, width, None)
    fit_v = tr_v if fit_rows is None else tr_v.join(fit_rows.select("row_id"), "row_id", "left_semi")
    fit = RD.pca_fit(fit_v, k_pca)
    return RD.pca_project(tr_v, fit), RD.pca_project(te_v, fit), fit.k


def _stopped(preset: str, train: DataFrame, valid: DataFrame, rounds: int | None, patience: int | None, seed: int) -> MD.EarlyStopResult:
    """Boosting by a preset, with its rounds and patience unless others are given."""
    params = dict(MD.XGB_PRESETS[preset])
    patience = patience or params["early_stopping_rounds"]
    est = MD.gbt_from_xgb(params | ({"n_estimators": rounds} if rounds else {}), seed=seed)
    return MD.fit_early_stopping(MD.SparseBoosting(est), train, valid, patience)


def fused_metadata_scores(spark: SparkSession, sf_dir: str, encoding: str = "target", rounds: int | None = None,
                          patience: int | None = None, k_pca: int = 250, seed: int = 42) -> tuple[DataFrame, list, int]:
    """The metadata + reduced-matrix pipeline.

    ``encoding="target"``: fill -> target encoding (fitted on the train split
    only) -> scale -> hstack with the reduced matrix -> stratified 80/20 ->
    boosted trees with early stopping -> probability -> ``p > 0.5``.
    ``encoding="onehot"``: fill -> top-2 collapse -> one-hot -> align to train ->
    block weights 0.3 / 0.7 -> hstack -> boosted trees.

    Rounds and patience are those of the preset (``fused_2000``, ``onehot_300``); training
    ends with the patience.
    """
    from pyspark.ml.feature import VectorAssembler

    cols = ["lang", "source"]
    meta_tr = EN.fill_missing(T.document_metadata(spark, sf_dir, "labelled"), cols)
    meta_te = EN.fill_missing(T.document_metadata(spark, sf_dir, "unlabelled"), cols)
    split = pin(SP.split_stratified(meta_tr.select(F.col("ID").alias("row_id"), "label"), "label", 0.2, seed))
    in_train = split.where(F.col("split") == "train").select("row_id")
    tr_red, te_red, k_pca = reduced_tokens(spark, sf_dir, k_pca=k_pca, seed=seed, fit_rows=in_train)
    fit_part = meta_tr.join(split.where(F.col("split") == "train").select(F.col("row_id").alias("ID")), "ID", "left_semi")
    if encoding == "target":
        enc = EN.fit_target_encoder(fit_part, cols, weighting="sigmoid", smoothing=10.0)
        enc_tr = EN.apply_target_encoder(meta_tr, cols, enc)
        enc_te = EN.apply_target_encoder(meta_te, cols, enc)
        asm = VectorAssembler(inputCols=cols, outputCol="__meta")
        mtr = asm.transform(enc_tr).select(F.col("ID").alias("row_id"), "label", F.col("__meta").alias("features"))
        mte = asm.transform(enc_te).select(F.col("ID").alias("row_id"), F.col("__meta").alias("features"))
        # The reduced matrix is scaled (fitted on the train split only), the encodings are not.
        sc = SCL.PopulationScaler(center=True).fit(tr_red.join(in_train, "row_id", "left_semi"))
        tr_red, te_red = sc.transform(tr_red), sc.transform(te_red)
        red_w, meta_w = 1.0, 1.0
    elif encoding == "onehot":
        top = EN.fit_top_categories(fit_part, cols, 2)
        ctr, cte = EN.collapse_rare(meta_tr, cols, top), EN.collapse_rare(meta_te, cols, top)
        dic = EN.dummy_dictionary(ctr, cols)
        idx = pin(SE.nonconstant_selection(dic))
        n_meta = idx.count()
        mk = lambda df, lab: MX.WideMatrix(
            entries=EN.align_to_train(EN.one_hot_long(df, cols), dic),
            rows=df.select(F.col("ID").alias("row_id"), *(["label"] if lab else [])),
        )
        mtr = MX.to_vectors(MX.gather(mk(ctr, True), idx, bound_rows=n_meta), n_meta)
        mte = MX.to_vectors(MX.gather(mk(cte, False), idx, bound_rows=n_meta), n_meta)
        red_w, meta_w = 0.7 / k_pca, 0.3 / n_meta
    else:
        raise ValueError(encoding)
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    def weighted(df, w, width):
        if w == 1.0:
            return df
        ep = ElementwiseProduct(scalingVec=Vectors.dense([w] * width), inputCol="features", outputCol="__w")
        return ep.transform(df).drop("features").withColumnRenamed("__w", "features")

    n_meta_cols = len(cols) if encoding == "target" else n_meta
    tr = weighted(mtr, meta_w, n_meta_cols).withColumnRenamed("features", "__m").join(
        weighted(tr_red, red_w, k_pca).select("row_id", F.col("features").alias("__r")), "row_id"
    )
    te = weighted(mte, meta_w, n_meta_cols).withColumnRenamed("features", "__m").join(
        weighted(te_red, red_w, k_pca).select("row_id", F.col("features").alias("__r")), "row_id"
    )
    asm = VectorAssembler(inputCols=["__m", "__r"], outputCol="features")
    tr = asm.transform(tr).select("row_id", "label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    te = asm.transform(te).select("row_id", "features")
    tr_part = tr.join(split.where(F.col("split") == "train").select("row_id"), "row_id", "left_semi")
    va_part = tr.join(split.where(F.col("split") == "test").select("row_id"), "row_id", "left_semi")
    res = _stopped("fused_2000" if encoding == "target" else "onehot_300", tr_part, va_part, rounds, patience, seed)
    return MD.score(res.model, te, ["row_id"]), res.curve, res.best_rounds


def _metadata_vectors(train: DataFrame, test_frames: dict[str, DataFrame], cols: list[str], encoding: str,
                      fit_part: DataFrame):
    """Encode metadata frames into ``(row_id[, label], features)`` vectors with the
    encoder fitted on ``fit_part`` only (no leakage into valid/test rows)."""
    from pyspark.ml.feature import VectorAssembler

    frames = {"train": train, **test_frames}
    out = {}
    if encoding == "onehot":
        top = EN.fit_top_categories(fit_part, cols, 2)
        dic = EN.dummy_dictionary(EN.collapse_rare(fit_part, cols, top), cols)
        idx = pin(SE.nonconstant_selection(dic))
        width = idx.count()
        for name, df in frames.items():
            c = EN.collapse_rare(df, cols, top)
            lab = ["label"] if "label" in df.columns else []
            m = MX.WideMatrix(
                entries=EN.align_to_train(EN.one_hot_long(c, cols), dic),
                rows=df.select(F.col("ID").alias("row_id"), *lab),
            )
            out[name] = MX.to_vectors(MX.gather(m, idx, bound_rows=width), width)
        return out
    enc = EN.fit_target_encoder(fit_part, cols, weighting="sigmoid", smoothing=10.0)
    asm = VectorAssembler(inputCols=cols, outputCol="features")
    for name, df in frames.items():
        lab = ["label"] if "label" in df.columns else []
        e = EN.apply_target_encoder(df, cols, enc)
        out[name] = asm.transform(e).select(F.col("ID").alias("row_id"), *lab, "features")
    return out


def metadata_model_accuracy(spark: SparkSession, sf_dir: str, rounds: int = 30, seed: int = 42) -> DataFrame:
    """Metadata only: fill -> top-2 collapse -> one-hot aligned to train ->
    stratified 80/20 -> boosted trees -> predicted class -> accuracy on both parts."""
    cols = ["lang", "source"]
    meta = EN.fill_missing(T.document_metadata(spark, sf_dir, "labelled"), cols)
    split = SP.split_stratified(meta.select(F.col("ID").alias("row_id"), "label"), "label", 0.2, seed)
    fit_part = meta.join(split.where(F.col("split") == "train").select(F.col("row_id").alias("ID")), "ID", "left_semi")
    vec = _metadata_vectors(meta, {}, cols, "onehot", fit_part)["train"].join(split.select("row_id", "split"), "row_id")
    vec = vec.persist(StorageLevel.MEMORY_AND_DISK)
    params = dict(MD.XGB_PRESETS["meta_300"], n_estimators=rounds)
    few = MD.right_size(vec.where(F.col("split") == "train"), vec.count(), vec.first()["features"].size)
    model = MD.gbt_from_xgb(params, seed=seed).fit(few.persist(StorageLevel.MEMORY_AND_DISK))
    few.unpersist()
    scored = model.transform(vec).select("split", "label", "prediction")
    return scored.groupBy("split").agg(
        F.avg((F.col("label").cast("double") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def three_way_report(spark: SparkSession, sf_dir: str, rounds: int | None = None, patience: int | None = None,
                     seed: int = 42) -> DataFrame:
    """Stratified 60/20/20 -> target encoding fitted on train -> population
    scaling -> hstack with the reduced token matrix -> boosted trees with early
    stopping on valid -> accuracy and log loss on valid and test (p > 0.5)."""
    from pyspark.ml.feature import VectorAssembler

    cols = ["lang", "source"]
    meta = EN.fill_missing(T.document_metadata(spark, sf_dir, "labelled"), cols)
    parts = pin(SP.split_three_way(meta.select(F.col("ID").alias("row_id"), "label"), "label", seed))
    in_train = parts.where(F.col("split") == "train").select("row_id")
    fit_part = meta.join(parts.where(F.col("split") == "train").select(F.col("row_id").alias("ID")), "ID", "left_semi")
    enc = _metadata_vectors(meta, {}, cols, "target", fit_part)["train"]
    # The reduced matrix is fitted and scaled on the train part; the encodings are left as they are.
    red_tr = reduced_tokens(spark, sf_dir, fit_rows=in_train)[0]
    red_tr = SCL.PopulationScaler(center=True).fit(red_tr.join(in_train, "row_id", "left_semi")).transform(red_tr)
    joined = enc.withColumnRenamed("features", "__m").join(red_tr.select("row_id", F.col("features").alias("__r")), "row_id")
    vec = VectorAssembler(inputCols=["__m", "__r"], outputCol="features").transform(joined).select("row_id", "label", "features")
    vec = vec.join(parts.select("row_id", "split"), "row_id").persist(StorageLevel.MEMORY_AND_DISK)
    res = _stopped("fused_2000", vec.where(F.col("split") == "train"), vec.where(F.col("split") == "valid"), rounds, patience, seed)
    scored = MD.score(res.model, vec.where(F.col("split") != "train"), ["split", "label"])
    p_true = F.when(F.col("label") == 1, F.col("p")).otherwise(F.lit(1.0) - F.col("p"))
    q = F.least(F.greatest(p_true, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    return scored.groupBy("split").agg(
        F.avg((F.col("label") == F.col("label_pred")).cast("double")).alias("accuracy"),
        F.avg(-F.log(q)).alias("log_loss"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("best_rounds", F.lit(res.best_rounds))
