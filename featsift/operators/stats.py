"""Per-column statistics over the long matrix (one ``groupBy(feature_id)``).

Zeros are implicit: with ``N`` rows in the spine and ``nnz`` stored cells of a
column, mean = sum / N, the population variance merges the stored cells'
``var_pop`` with ``N - nnz`` zeros (Chan et al. pairwise update, no Σv²−Σ²
cancellation), and min/max include 0 when ``nnz < N``.  Partial aggregation
absorbs hot columns before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.matrix import WideMatrix


def stats_source(m: WideMatrix):
    """(frame, value column) to aggregate per feature: the single-scan source with
    cells outside the matrix nulled, or the entries."""
    if m.scan is not None:
        return m.scan, F.when(F.col("__in"), F.col("value"))
    return m.entries, F.col("value")


def column_moments(m: WideMatrix, n_rows: int | None = None) -> DataFrame:
    """feature_id, nnz, total, mean, var, std, min, max, any_negative (over the column spine)."""
    n = int(n_rows if n_rows is not None else m.n_rows())
    src, v = stats_source(m)
    agg = src.groupBy("feature_id").agg(
        F.count(v).alias("nnz"),
        F.sum(v).alias("total"),
        F.avg(v).alias("__m1"),
        F.var_pop(v).alias("__v1"),
        F.min(v).alias("__mn"),
        F.max(v).alias("__mx"),
        F.max((v < 0).cast("int")).alias("__neg"),
    )
    base = m.feature_spine().join(agg, "feature_id", "left") if (m.columns is not None and m.scan is None) else agg
    nnz = F.coalesce(F.col("nnz"), F.lit(0)).cast("long")
    n_lit = F.lit(float(n))
    m2 = F.when(nnz == 0, F.lit(0.0)).otherwise(
        F.col("__v1") * nnz + nnz * (n_lit - nnz) / n_lit * F.col("__m1") * F.col("__m1")
    )
    sparse_col = nnz < F.lit(n)
    return base.select(
        "feature_id",
        nnz.alias("nnz"),
        F.coalesce(F.col("total"), F.lit(0.0)).alias("total"),
        (F.coalesce(F.col("total"), F.lit(0.0)) / n_lit).alias("mean"),
        (m2 / n_lit).alias("var"),
        F.sqrt(m2 / n_lit).alias("std"),
        F.when(nnz == 0, 0.0).when(sparse_col, F.least(F.col("__mn"), F.lit(0.0))).otherwise(F.col("__mn")).alias("min"),
        F.when(nnz == 0, 0.0).when(sparse_col, F.greatest(F.col("__mx"), F.lit(0.0))).otherwise(F.col("__mx")).alias("max"),
        (F.coalesce(F.col("__neg"), F.lit(0)) == 1).alias("any_negative"),
    )


def feature_std(m: WideMatrix, n_rows: int | None = None) -> DataFrame:
    """A1: population standard deviation per column."""
    return column_moments(m, n_rows).select("feature_id", "std")


def feature_variance(m: WideMatrix, n_rows: int | None = None) -> DataFrame:
    """A2: population variance per column."""
    return column_moments(m, n_rows).select("feature_id", "var")


def nonconstant_features(m: WideMatrix, eps: float = 0.0, n_rows: int | None = None) -> DataFrame:
    """A3: columns with ``std > eps`` (the kept list); ``eps`` = 0 or 1e-12 in practice."""
    return column_moments(m, n_rows).where(F.col("std") > F.lit(eps)).select("feature_id")


def constant_features_by_std(m: WideMatrix, n_rows: int | None = None) -> DataFrame:
    """A3 complement: columns with ``std == 0`` (the dropped list)."""
    return column_moments(m, n_rows).where(F.col("std") == 0).select("feature_id")


def constant_by_value(m: WideMatrix, n_rows: int | None = None) -> DataFrame:
    """A4: exact constancy (every row equals row 0), zero-aware, no tolerance."""
    mo = column_moments(m, n_rows)
    return mo.select("feature_id", (F.col("min") == F.col("max")).alias("is_constant"))


def constant_count(m: WideMatrix, n_rows: int | None = None) -> DataFrame:
    """A5: number of zero-std columns, and the column count."""
    mo = column_moments(m, n_rows)
    return mo.agg(
        F.count_if(F.col("std") == 0).cast("long").alias("n_constant"), F.count(F.lit(1)).alias("n_columns")
    )


def negative_columns(m: WideMatrix) -> DataFrame:
    """Per column, whether any value is negative (implicit zeros never are)."""
    src, v = stats_source(m)
    mo = src.groupBy("feature_id").agg(F.max((v < 0).cast("int")).alias("__neg"))
    base = m.feature_spine().join(mo, "feature_id", "left") if (m.columns is not None and m.scan is None) else mo
    return base.select("feature_id", (F.coalesce(F.col("__neg"), F.lit(0)) == 1).alias("has_negative"))


def negative_column_count(m: WideMatrix) -> DataFrame:
    """Number of columns holding a negative value."""
    neg = m.entries.where(F.col("value") < 0).select("feature_id").distinct()
    return neg.agg(F.count(F.lit(1)).alias("n_negative_columns"))


def assert_finite(m: WideMatrix) -> None:
    """Ingest contract: no null, NaN or infinite cell (one filtered pass)."""
    v = F.col("value")
    bad = m.entries.where(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))).limit(1).count()
    if bad:
        raise ValueError("matrix holds null, NaN or infinite values")


def assert_non_negative(m: WideMatrix) -> None:
    """Chi-square needs non-negative input; fail early with the count."""
    bad = m.entries.where(F.col("value") < 0).select("feature_id").distinct().count()
    if bad:
        raise ValueError(f"chi2 needs non-negative values: {bad} columns hold negatives")


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``value_counts`` of several categorical columns at once -> (column, value, n).
    Nulls are excluded, as in the reference; fill them first to count them."""
    if not cols:
        raise ValueError("no columns")
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (`column`, value)").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def scaler_fit(m: WideMatrix, n_rows: int | None = None) -> DataFrame:
    """Per-column mean and population std (Spark's StandardScaler uses the sample std)."""
    return column_moments(m, n_rows).select("feature_id", "mean", "std")


def target_stats(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """Per (column, category): count and mean of the label; plus the prior as ``prior``."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (`column`, value)", f"CAST(`{label}` AS DOUBLE) AS __y")
    stats = long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__y").alias("y_sum"), F.avg("__y").alias("y_mean")
    )
    # The prior is one number: computed once, inlined as a literal.
    prior = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return stats.withColumn("prior", F.lit(prior).cast("double"))
