"""Classifiers (Spark ML), boosted-tree early stopping, and scoring.

* Logistic regression: the reference's L2, C = 1 on a summed loss equals
  Spark's mean loss with ``regParam = 1/N``; no internal standardisation.
* Random forest: 200 trees, depth 20, sqrt features, at least 2 rows per leaf.
* Boosted trees: ``GBTClassifier``, on wide sparse vectors trained by
  ``sparse_boosting`` (the same method on stored cells).  XGBoost-style parameters are mapped where
  Spark has an equivalent; leaf L1/L2 penalties have none and are reported.
* Early stopping: the best round under the patience rule by the loss on the
  validation rows, and the first trees of the ensemble up to it.  ``sparse_boosting``
  stops training there; ``GBTClassifier`` fits ``n`` rounds once and evaluates every
  prefix (``evaluateEachIteration``).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.sparse_boosting import SparseBoosted, SparseBoosting

# Boosting configurations used by the reference scripts
# (rounds, learning rate, depth, row fraction, column fraction, min child weight,
# gamma, L2, L1, early-stopping patience).
XGB_PRESETS: dict[str, dict] = {
    "tall_3000": dict(n_estimators=3000, learning_rate=0.01, max_depth=8, subsample=0.8, colsample_bytree=0.8,
                      min_child_weight=1, gamma=0.0, reg_lambda=1.5, reg_alpha=0.5, early_stopping_rounds=100),
    "wide_2000": dict(n_estimators=2000, learning_rate=0.02, max_depth=8, subsample=0.8, colsample_bytree=0.8),
    "wide_2000_shallow": dict(n_estimators=2000, learning_rate=0.03, max_depth=4, subsample=0.6,
                              colsample_bytree=0.2, min_child_weight=5, reg_lambda=3, reg_alpha=2),
    "onehot_300": dict(n_estimators=300, learning_rate=0.1, max_depth=6, early_stopping_rounds=20),
    "meta_100": dict(n_estimators=100, learning_rate=0.1, max_depth=6),
    "fused_2000": dict(n_estimators=2000, learning_rate=0.02, max_depth=7, subsample=0.7, colsample_bytree=0.7,
                       min_child_weight=5, reg_lambda=2, reg_alpha=0.2, early_stopping_rounds=80),
    "reduced_300": dict(n_estimators=300, learning_rate=0.1, max_depth=6, subsample=0.8, colsample_bytree=0.1,
                        min_child_weight=3, gamma=0.1, reg_lambda=1),
    "meta_300": dict(n_estimators=300, learning_rate=0.1, max_depth=6, subsample=0.8, colsample_bytree=1.0,
                     min_child_weight=3, gamma=0.1, reg_lambda=1),
    "meta_50": dict(n_estimators=50, learning_rate=0.1, max_depth=4),
}


def logistic_regression(n_rows: int, max_iter: int = 1000, c: float = 1.0, tol: float = 1e-4,
                        features: str = "features", label: str = "label") -> LogisticRegression:
    """L2 logistic regression; ``tol`` 1e-4 as the reference library's default."""
    return LogisticRegression(
        featuresCol=features, labelCol=label, maxIter=max_iter, regParam=1.0 / (c * max(n_rows, 1)),
        elasticNetParam=0.0, standardization=False, family="binomial", tol=tol,
    )


TARGET_PARTITION_BYTES = 32 << 20


def right_size(vectors: DataFrame, n_rows: int, width: int) -> DataFrame:
    """Coalesce (no shuffle) a dense-vector training set to about 32 MB per partition.

    Iterative optimisers run one job per iteration, so on small inputs the task
    count, not the data, sets the time; on large inputs the byte estimate keeps
    thousands of partitions and this is a no-op.
    """
    est = n_rows * (width * 8 + 16)
    target = max(1, -(-est // TARGET_PARTITION_BYTES))
    # coalesce never adds partitions, so a target above the current count is a no-op
    # (and no plan has to be executed to learn that count).
    return vectors.coalesce(int(target))


def random_forest(num_trees: int = 200, max_depth: int = 20, min_leaf: int = 2, seed: int = 42,
                  features: str = "features", label: str = "label", max_bins: int = 32,
                  bootstrap: bool = True, subset: str = "sqrt") -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
        featureSubsetStrategy=subset, minInstancesPerNode=min_leaf, bootstrap=bootstrap, seed=seed, maxBins=max_bins,
    )


def gbt_from_xgb(params: dict, seed: int = 42, features: str = "features", label: str = "label",
                 max_bins: int = 32) -> GBTClassifier:
    """Map XGBoost-style parameters onto ``GBTClassifier``.

    rounds -> maxIter, learning_rate -> stepSize, max_depth -> maxDepth (<= 30),
    subsample -> subsamplingRate, colsample -> featureSubsetStrategy (per node in
    Spark), min_child_weight (hessian sum, <= 0.25 per row) -> minInstancesPerNode
    (4 rows per unit), gamma -> minInfoGain (another scale).  reg_lambda /
    reg_alpha have no equivalent: a warning names them.
    """
    if int(params.get("max_depth", 6)) > 30:
        raise ValueError("Spark grows trees to depth 30 at most")
    unsupported = [k for k in ("reg_lambda", "reg_alpha") if params.get(k)]
    if unsupported:
        warnings.warn(f"GBTClassifier has no leaf penalty: ignoring {unsupported}", stacklevel=2)
    col = params.get("colsample_bytree", 1.0)
    return GBTClassifier(
        featuresCol=features,
        labelCol=label,
        maxIter=int(params.get("n_estimators", 100)),
        stepSize=float(params.get("learning_rate", 0.1)),
        maxDepth=int(params.get("max_depth", 6)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy="all" if col >= 1.0 else str(col),
        minInstancesPerNode=max(1, int(round(4 * params.get("min_child_weight", 0.25)))),
        minInfoGain=float(params.get("gamma", 0.0)),
        lossType="logistic",
        seed=seed,
        maxBins=max_bins,
    )


@dataclass
class EarlyStopResult:
    model: GBTClassificationModel | SparseBoosted
    best_rounds: int
    curve: list[tuple[int, str, float]]


def eval_curve(model: GBTClassificationModel | SparseBoosted, frames: dict[str, DataFrame]) -> list[tuple[int, str, float]]:
    """Loss after each round on each named frame (one distributed pass per frame)."""
    out = []
    for name, df in frames.items():
        for i, loss in enumerate(model.evaluateEachIteration(df)):
            out.append((i + 1, name, float(loss)))
    return out


def best_round(losses: list[float], patience: int) -> int:
    """Stop when the loss has not improved for ``patience`` rounds; return the best round (1-based)."""
    best, best_i, since = float("inf"), 0, 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, best_i, since = loss, i, 0
        else:
            since += 1
            if since >= patience:
                break
    return best_i + 1


def first_rounds(model: GBTClassificationModel | SparseBoosted, rounds: int) -> GBTClassificationModel | SparseBoosted:
    """The boosted model after its first ``rounds`` trees; nothing is trained again."""
    if isinstance(model, SparseBoosted):
        return model.first(rounds)
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    regressor = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = gateway.new_array(regressor, rounds), gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    boosted = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel
    cut = GBTClassificationModel(boosted(java.uid(), trees, weights, java.numFeatures(), 2))
    return model._copyValues(cut)


def fit_early_stopping(est: GBTClassifier | SparseBoosting, train: DataFrame, valid: DataFrame, patience: int) -> EarlyStopResult:
    """One fit, per-round validation loss, patience, the trees up to the best round."""
    if isinstance(est, SparseBoosting):
        full, curve = est.watched(train, valid, patience)
    else:
        full = est.fit(train)
        curve = eval_curve(full, {"train": train, "valid": valid})
    valid_losses = [loss for _, name, loss in curve if name == "valid"]
    best = best_round(valid_losses, patience)
    model = full if best == full.getNumTrees else first_rounds(full, best)
    return EarlyStopResult(model=model, best_rounds=best, curve=curve)


def score(model, df: DataFrame, keep: list[str], cut: float = 0.5) -> DataFrame:
    """Probability of class 1 and the 0/1 label (strict ``p > cut``)."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability")).getItem(1)
    return out.select(*keep, p.alias("p"), (p > F.lit(cut)).cast("int").alias("label_pred"))
