"""Centred sparse matrices: stored cells plus one number per column.

Standardising turns an implicit zero into ``-mean / std``.  Such a matrix is kept as
``cells`` (the stored ones, divided by std) and ``shift(feature_id, shift)``, which every
row has in every column: X = cells + 1 shift^T, a sparse matrix plus one of rank one.
Zeros are neither filled in nor left out; sums over columns or rows treat the shift in
closed form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.matrix import WideMatrix, join_fitted
from featsift.operators.scale import _safe_std


@dataclass(frozen=True)
class ShiftedMatrix:
    cells: DataFrame  # (row_id, feature_id, value)
    shift: DataFrame  # (feature_id, shift), one row for each column of the spine
    rows: DataFrame


def standardize(m: WideMatrix, fit: DataFrame, bound_rows: int | None = None) -> ShiftedMatrix:
    """E5 over every cell: ``(x - mean) / std`` with ``fit(feature_id, mean, std)`` of the
    column spine (a zero std divides by one).  Cells of columns outside the fit leave."""
    std = _safe_std(F.col("std"))
    scale = fit.select("feature_id", std.alias("std"))
    cells = join_fitted(m.entries, scale, "feature_id", bound_rows=bound_rows)
    return ShiftedMatrix(
        cells.select("row_id", "feature_id", (F.col("value") / F.col("std")).alias("value")),
        fit.select("feature_id", (-F.col("mean") / std).alias("shift")), m.rows,
    )


def row_products(x: ShiftedMatrix, weights: DataFrame) -> DataFrame:
    """``(row_id, product)`` of every row with ``weights(feature_id, weight)``."""
    joined = x.cells.join(weights, "feature_id")
    stored = joined.groupBy("row_id").agg(F.sum(F.col("value") * F.col("weight")).alias("product"))
    constant = x.shift.join(weights, "feature_id").agg(F.coalesce(F.sum(F.col("shift") * F.col("weight")), F.lit(0.0))).first()[0]
    return x.rows.select("row_id").join(stored, "row_id", "left").select(
        "row_id", (F.coalesce("product", F.lit(0.0)) + F.lit(constant)).alias("product")
    )


def row_energy(x: ShiftedMatrix) -> DataFrame:
    """``(row_id, energy)``: each row's squared length over all columns.  A stored cell
    replaces its column's zero: (v + s)^2 instead of s^2."""
    v, s = F.col("value"), F.col("shift")
    more = x.cells.join(x.shift, "feature_id").groupBy("row_id").agg(F.sum(v * (v + 2 * s)).alias("more"))
    zeros = x.shift.agg(F.coalesce(F.sum(s * s), F.lit(0.0))).first()[0]
    return x.rows.select("row_id").join(more, "row_id", "left").select(
        "row_id", (F.coalesce("more", F.lit(0.0)) + F.lit(zeros)).alias("energy")
    )


def column_sums(x: ShiftedMatrix, rows: DataFrame | None = None) -> DataFrame:
    """``(feature_id, total, squares)`` of each column over all rows or those of
    ``rows(row_id)``, zeros included."""
    cells = x.cells if rows is None else x.cells.join(rows.select("row_id"), "row_id", "left_semi")
    n = float((x.rows if rows is None else rows).count())
    v, s = F.col("value"), F.col("shift")
    stored = cells.groupBy("feature_id").agg(F.sum(v).alias("v"), F.sum(v * v).alias("vv"))
    v, vv = (F.coalesce(c, F.lit(0.0)) for c in ("v", "vv"))
    return x.shift.join(stored, "feature_id", "left").select(
        "feature_id", (v + s * n).alias("total"), (vv + 2 * s * v + s * s * n).alias("squares")
    )
