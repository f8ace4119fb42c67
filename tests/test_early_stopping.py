"""Early stopping cuts the fitted ensemble; fusing and scoring read each table few times."""

import random

import pytest
from pyspark.ml.linalg import Vectors

from featsift.operators import models as MD


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(7)
    rows = [(int(x[0] + rng.random() > 1), Vectors.dense(x)) for x in ([rng.random() for _ in range(4)] for _ in range(400))]
    return spark.createDataFrame(rows[:250], ["label", "features"]), spark.createDataFrame(rows[250:], ["label", "features"])


def _p(model, df):
    return [tuple(r.probability) for r in model.transform(df).select("probability").collect()]


def test_first_rounds_is_the_shorter_fit(frames):
    train, valid = frames
    full = MD.gbt_from_xgb(dict(n_estimators=8, max_depth=3)).fit(train)
    cut, short = MD.first_rounds(full, 3), MD.gbt_from_xgb(dict(n_estimators=3, max_depth=3)).fit(train)
    assert cut.getNumTrees == 3
    assert [t.toDebugString for t in cut.trees] and len(cut.trees) == 3
    assert _p(cut, valid) == _p(short, valid)
    assert _p(cut, valid) != _p(full, valid)


def test_early_stopping_keeps_the_best_round(frames):
    train, valid = frames
    res = MD.fit_early_stopping(MD.gbt_from_xgb(dict(n_estimators=15, max_depth=4)), train, valid, patience=3)
    losses = [loss for _, name, loss in res.curve if name == "valid"]
    assert res.best_rounds == MD.best_round(losses, 3) == res.model.getNumTrees
    assert losses[res.best_rounds - 1] == min(losses[: res.best_rounds])
    assert res.best_rounds < 15  # noisy labels: deep trees overfit early
