"""Standardised sparse matrices against NumPy over every cell."""

import numpy as np

from featsift.operators import shifted as SH
from featsift.operators import stats as ST
from featsift.operators.matrix import WideMatrix


def test_every_cell_counts(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 4, (40, 9)) * (rng.random((40, 9)) < 0.4).astype(float)
    x[:, 3], x[:, 4], x[7] = 2.0, 0.0, 0.0
    x[7, 3] = 2.0
    m = WideMatrix(
        entries=spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row_id long, feature_id long, value double"),
        rows=spark.createDataFrame([(i,) for i in range(40)], "row_id long"),
        columns=spark.createDataFrame([(j,) for j in range(9)], "feature_id long"), label_col=None,
    )
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    s = SH.standardize(m, ST.column_moments(m).select("feature_id", "mean", "std"))
    w = rng.normal(size=9)
    weights = spark.createDataFrame([(j, float(w[j])) for j in range(9)], "feature_id long, weight double")
    assert np.allclose([r.product for r in SH.row_products(s, weights).orderBy("row_id").collect()], z @ w)
    assert np.allclose([r.energy for r in SH.row_energy(s).orderBy("row_id").collect()], (z**2).sum(axis=1))
    some = m.rows.where("row_id % 3 = 1")
    for rows, part in ((None, z), (some, z[1::3])):
        got = SH.column_sums(s, rows).orderBy("feature_id").collect()
        assert np.allclose([[r.total, r.squares] for r in got], np.c_[part.sum(axis=0), (part**2).sum(axis=0)])
