"""One test for each fault found in review that a query does not show."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from featsift.functions.special import chi2_sf, f_sf
from featsift.operators import models as MD
from featsift.operators import scale as SCL
from featsift.operators import scores as SC
from featsift.operators import split as SP
from featsift.operators.matrix import WideMatrix
from featsift.sources.metadata import read_metadata_csv


@pytest.mark.parametrize("center", [True, False])
def test_column_constant_in_train_keeps_other_values(spark, center):
    fit = spark.createDataFrame([(i, Vectors.dense([5.0, float(i)])) for i in range(4)], ["row_id", "features"])
    new = spark.createDataFrame([(9, Vectors.dense([7.0, 1.5]))], ["row_id", "features"])
    got = SCL.PopulationScaler(center=center).fit(fit).transform(new).first().features
    std = np.arange(4).std()
    assert np.allclose(got.toArray(), [2.0, 0.0] if center else [7.0, 1.5 / std])


def test_chi2_rejects_negative_cells(spark):
    entries = spark.createDataFrame([(0, 1, -1.0), (1, 1, 2.0), (2, 1, 3.0)], "row_id long, feature_id long, value double")
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "row_id long, label int")
    with pytest.raises(Exception, match="non-negative"):
        SC.SCORERS["chi2"](WideMatrix(entries=entries, rows=rows)).collect()


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('ID,a,b\n1,"say ""hi"", x","two\nlines"\n2,,z\n')
    rows = {r.ID: (r.a, r.b) for r in read_metadata_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"1": ('say "hi", x', "two\nlines"), "2": (None, "z")}


def test_integer_ids_survive_ingest(spark, tmp_path):
    from featsift.sources import archive

    np.save(tmp_path / "ids.npy", np.array([7, 12345678901234567]))
    spark.dataSource.register(archive.NpyVectorSource)
    got = spark.read.format(archive.NpyVectorSource.name()).option("path", str(tmp_path / "ids.npy")).load()
    assert sorted(r.value for r in got.collect()) == ["12345678901234567", "7"]


def test_too_deep_trees_are_refused():
    with pytest.raises(ValueError):
        MD.gbt_from_xgb({"max_depth": 31})
    with pytest.warns(UserWarning, match="reg_lambda"):
        MD.gbt_from_xgb({"reg_lambda": 2})


def test_class_limit_holds_before_the_collect(spark, monkeypatch):
    monkeypatch.setattr(SP, "MAX_CLASSES", 3)
    rows = spark.range(10).selectExpr("id AS row_id", "int(id) AS label")
    with pytest.raises(ValueError):
        SP.split_stratified(rows)


def test_tails_against_sampled_integrals():
    """Survival functions against a fine trapezoid over the densities."""
    import math

    for d1, d2 in ((1, 7), (2, 10), (9, 3990), (1, 100_000)):
        f = np.array([0.01, 0.5, 1.0, 3.0, 12.0])
        t = np.concatenate([[0.0], np.geomspace(1e-12, 4000, 2_000_001)])
        log_c = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
        dens = np.exp(log_c + (d1 / 2 - 1) * np.log(np.maximum(t, 1e-300)) - (d1 + d2) / 2 * np.log1p(d1 * t / d2))
        dens[0] = dens[1]
        cum = np.concatenate([[0.0], np.cumsum((dens[1:] + dens[:-1]) / 2 * np.diff(t))])
        assert np.allclose(f_sf(f, d1, d2), cum[-1] - np.interp(f, t, cum), atol=2e-5)
    assert np.allclose(chi2_sf(np.array([0.0, 2.0, 40.0]), 2), np.exp([0.0, -1.0, -20.0]))
    assert chi2_sf(np.array([np.inf]), 3)[0] == 0.0 and abs(chi2_sf(np.array([3.841458820694124]), 1)[0] - 0.05) < 1e-12
