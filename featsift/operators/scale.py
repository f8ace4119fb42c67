"""Standardisation and block weighting.

Centring turns implicit zeros into ``-mean/std``, so the long-form transform is
complete only for dense matrices (or with ``center=False``, which keeps zeros
at zero).  Sparse matrices are standardised in vector form after selection,
where the width is the selected ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.matrix import WideMatrix, join_fitted


def _safe_std(c: F.Column) -> F.Column:
    """A zero std divides by one (constant columns map to 0 after centring)."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def standardize_entries(m: WideMatrix, fit: DataFrame, center: bool = True, bound_rows: int | None = None) -> WideMatrix:
    """E5, long form: ``(v - mean) / std`` on stored cells via a join with the fit."""
    f = fit.select("feature_id", F.col("mean").alias("__mean"), F.col("std").alias("__std"))
    e = join_fitted(m.entries, f, "feature_id", bound_rows=bound_rows)
    shift = F.col("__mean") if center else F.lit(0.0)
    e = e.withColumn("value", (F.col("value") - shift) / _safe_std(F.col("__std"))).drop("__mean", "__std")
    return m.with_entries(e, m.columns)


def vector_fit(vectors: DataFrame, col: str = "features") -> DataFrame:
    """A12 in vector form: one row with ``mean`` and population ``std`` arrays
    (``Summarizer``: a tree aggregate, no shuffle of rows)."""
    from pyspark.ml.stat import Summarizer

    s = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("s"))
    from pyspark.ml.functions import vector_to_array

    n = F.col("s.count").cast("double")
    return s.select(
        vector_to_array(F.col("s.mean")).alias("mean"),
        # Summarizer's variance is the sample one: rescale to population.
        F.transform(vector_to_array(F.col("s.variance")), lambda v: F.sqrt(v * (n - 1) / n)).alias("std"),
    )


def standardize_vectors(vectors: DataFrame, fit: DataFrame, col: str = "features", out: str = "features") -> DataFrame:
    """E5, vector form: element-wise ``(x - mean) / std`` with the one-row fit
    broadcast (its size is the vector width)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # The fit is one row of two arrays of the vector width (at most DENSE_MAX_WIDTH
    # when centring): inlined as array literals rather than joined to every row.
    row = fit.first()
    mean = F.lit([float(x) for x in row["mean"]])
    std = F.lit([float(x) if x != 0 else 1.0 for x in row["std"]])
    scaled = F.zip_with(F.zip_with(vector_to_array(F.col(col)), mean, lambda x, mu: x - mu), std, lambda d, s: d / s)
    keep = [c for c in vectors.columns if c != col]
    return vectors.select(*keep, array_to_vector(scaled).alias(out))


def weight_block(m: WideMatrix, weight: float, n_cols: int) -> WideMatrix:
    """Every value times ``weight / n_cols`` (n_cols after alignment)."""
    if n_cols <= 0:
        raise ValueError("n_cols must be positive")
    e = m.entries.withColumn("value", F.col("value") * F.lit(float(weight)) / F.lit(float(n_cols)))
    return m.with_entries(e, m.columns)


class PopulationScaler:
    """E5 in vector form with the population std.

    * ``center=True`` (narrow, dense vectors): ``(x - mean) / std`` from
      ``vector_fit`` arrays, JVM-side ``zip_with``.
    * ``center=False`` (wide, sparse vectors): one ``ElementwiseProduct`` by
      ``1 / std``, which keeps vectors sparse.
    * Either way a zero std divides by one: a column that is constant in the
      rows fitted keeps its (centred) value in other rows.
    """

    def __init__(self, center: bool = True, col: str = "features"):
        self.center, self.col = center, col
        self._fit = None
        self._scale: list[float] = []

    def fit(self, vectors: DataFrame) -> "PopulationScaler":
        if self.center:
            self._fit = vector_fit(vectors, self.col).cache()
            return self
        row = vector_fit(vectors, self.col).first()
        # One vector of the selected width, as a fitted model holds it.
        self._scale = [1.0 / s if s else 1.0 for s in row["std"]]
        return self

    def transform(self, vectors: DataFrame) -> DataFrame:
        if self.center:
            return standardize_vectors(vectors, self._fit, self.col, self.col)
        from pyspark.ml.feature import ElementwiseProduct
        from pyspark.ml.linalg import Vectors

        ep = ElementwiseProduct(scalingVec=Vectors.dense(self._scale), inputCol=self.col, outputCol="__scaled")
        return ep.transform(vectors).drop(self.col).withColumnRenamed("__scaled", self.col)
