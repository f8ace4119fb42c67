"""The long sparse matrix, its spines, and the structural operators on it.

``entries(row_id, feature_id, value)`` holds the non-zero cells only; ``rows``
is the row spine (unique ``row_id``, optionally ``label``); ``columns`` is the
optional column spine (unique ``feature_id``) so that all-zero columns, which
have no entries, still exist for statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.hot import join_apart
from featsift.operators.ranking import top_k

# Fitted tables with at most this many rows are broadcast by the operators; a
# larger (or unknown) side is left to the planner, where AQE broadcasts it only
# if its measured size is under spark.sql.adaptive.autoBroadcastJoinThreshold.
BROADCAST_ROWS = 2_000_000
MAX_CLASSES = 256


@dataclass(frozen=True)
class WideMatrix:
    entries: DataFrame
    rows: DataFrame
    columns: DataFrame | None = None
    label_col: str | None = "label"
    # Optional single-scan source: the cells of every row that defines the column
    # spine (e.g. train and test documents), with a boolean ``__in`` marking the
    # rows of this matrix.  Per-feature statistics then aggregate once over it,
    # with no second scan for the spine and no spine join.
    scan: DataFrame | None = None

    def with_entries(self, entries: DataFrame, columns: DataFrame | None = None,
                     scan: DataFrame | None = None) -> "WideMatrix":
        return replace(self, entries=entries, columns=columns, scan=scan)

    def n_rows(self) -> int:
        return self.rows.count()

    def class_counts(self) -> dict[int, int]:
        """Class -> row count, from the spine (implicit zeros make entries useless here)."""
        if not self.label_col:
            raise ValueError("matrix has no label")
        got = self.rows.groupBy(self.label_col).count().limit(MAX_CLASSES + 1).collect()
        if len(got) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        out = {int(r[0]): int(r[1]) for r in got if r[0] is not None}
        if len(out) != len(got):
            raise ValueError("null labels in the row spine")
        return dict(sorted(out.items()))

    def feature_spine(self) -> DataFrame:
        if self.columns is not None:
            return self.columns.select("feature_id")
        return self.entries.select("feature_id").distinct()


def join_fitted(big: DataFrame, fitted: DataFrame, on, how: str = "inner", bound_rows: int | None = None) -> DataFrame:
    """Join a big frame with a fitted table.  Broadcast only when ``bound_rows``
    (a static bound such as a top-k size) proves the side small; otherwise the
    planner/AQE decides on measured sizes, and AQE splits skewed partitions."""
    if bound_rows is not None and bound_rows <= BROADCAST_ROWS:
        fitted = F.broadcast(fitted)
    return big.join(fitted, on, how)


def shape(m: WideMatrix) -> DataFrame:
    """Rows, columns and stored entries."""
    # The row count is one number, inlined; the rest is one aggregate.
    n_rows = m.rows.select(F.count_distinct("row_id")).first()[0]
    if m.scan is not None:
        # One pass over the single-scan source: spine width and the matrix's cells.
        return m.scan.agg(
            F.lit(n_rows).cast("long").alias("n_rows"),
            F.count_distinct("feature_id").alias("n_columns"),
            F.count_if(F.col("__in")).cast("long").alias("n_entries"),
        )
    nnz = m.entries.count()
    return m.feature_spine().agg(
        F.lit(n_rows).cast("long").alias("n_rows"),
        F.count_distinct("feature_id").alias("n_columns"),
        F.lit(nnz).cast("long").alias("n_entries"),
    )


def prefix_features(m: WideMatrix, k: int) -> WideMatrix:
    """The first ``k`` columns in column order.  The bound is the k-th
    smallest feature id of the spine, so the cut is a range filter that reaches
    the scan instead of a join."""
    spine = m.feature_spine()
    kth = top_k(spine, k, [F.col("feature_id")]).agg(F.max("feature_id")).first()[0]
    if kth is None:
        return m
    cut = F.col("feature_id") <= F.lit(kth)
    cols = m.columns.where(cut) if m.columns is not None else None
    scan = m.scan.where(cut) if m.scan is not None else None
    return m.with_entries(m.entries.where(cut), cols, scan)


def gather(m: WideMatrix, selected: DataFrame, bound_rows: int | None = None) -> WideMatrix:
    """Keep the fitted ``selected(feature_id, new_index)`` columns, re-indexed.  A selection
    without a bound is joined as in ``drop_features``."""
    sel = selected.select("feature_id", "new_index")
    if bound_rows is not None and bound_rows <= BROADCAST_ROWS:
        entries = join_fitted(m.entries, sel, "feature_id", bound_rows=bound_rows)
    else:
        entries = join_apart(m.entries, sel, "feature_id")
    return m.with_entries(entries, sel.select("feature_id", "new_index"))


def drop_features(m: WideMatrix, dropped: DataFrame, bound_rows: int | None = None) -> WideMatrix:
    """Delete the listed columns (anti join).  A list without a bound meets the frequent
    columns' cells where they are and the others through a shuffle."""
    d = dropped.select("feature_id").distinct()
    if bound_rows is not None and bound_rows <= BROADCAST_ROWS:
        entries = join_fitted(m.entries, d, "feature_id", "left_anti", bound_rows)
    else:
        entries = join_apart(m.entries, d, "feature_id", "left_anti")
    cols = join_fitted(m.columns, d, "feature_id", "left_anti", bound_rows) if m.columns is not None else None
    return m.with_entries(entries, cols)


# Vector assembly: Spark SQL has no scatter, so a JVM-side dense build looks every
# slot up in a per-row map (a linear scan: O(width * cells) per row).  Above
# DENSE_BUILD_MAX_WIDTH the vector is built sparse instead: an Arrow-batched UDF
# wraps the JVM-sorted index/value arrays (measured faster from ~500 columns).
DENSE_BUILD_MAX_WIDTH = 64
# Up to this width training vectors count as dense when partitions are sized.
DENSE_MAX_WIDTH = 4096


def _sparse_vector_udf(width: int):
    """Sparse vectors from index and value arrays, a whole Arrow batch at a time."""
    from pyspark.ml.linalg import VectorUDT

    @F.arrow_udf(VectorUDT())
    def make(idx: pa.Array, val: pa.Array) -> pa.Array:
        sizes = idx.value_lengths().to_numpy(zero_copy_only=False)
        flat = idx.flatten().to_numpy(zero_copy_only=False)
        starts = np.zeros(len(flat), dtype=bool)
        ends = np.cumsum(sizes)
        starts[(ends - sizes)[sizes > 0]] = True
        if (np.diff(flat)[~starts[1:]] <= 0).any():
            raise TypeError("indices of a vector must be strictly increasing")
        if len(flat) and not 0 <= flat.min() <= flat.max() < width:
            raise ValueError(f"an index lies outside 0 to {width - 1}")
        values = val.flatten()
        if values.null_count:
            raise TypeError("a value of a vector is null")
        offsets = pa.array(np.r_[0, ends].astype(np.int32))
        n = len(idx)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n, dtype=np.int8)), pa.array(np.full(n, width, dtype=np.int32)),
             pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(offsets, values.cast(pa.float64()))],
            names=["type", "size", "indices", "values"],
        )

    return make


def to_vectors(m: WideMatrix, width: int, index_col: str = "new_index", keep: list[str] | None = None,
               sparse: bool | None = None) -> DataFrame:
    """(row_id, [label,] features): one ml vector of ``width`` slots per spine row.

    Entries must carry ``index_col`` (0-based, < width), e.g. from ``gather``.
    The row spine is the left side, so a row with no selected entry keeps an
    all-zero vector (it must not vanish).  Each row collects at most ``width``
    cells, a bound set by the selection.
    """
    from pyspark.ml.functions import array_to_vector

    sparse = width > DENSE_BUILD_MAX_WIDTH if sparse is None else sparse
    keep = keep if keep is not None else [c for c in m.rows.columns if c != "row_id"]
    cells = m.entries.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(index_col).cast("int").alias("i"), F.col("value").alias("v")))).alias(
            "__cells"
        )
    )
    joined = m.rows.join(cells, "row_id", "left")
    if sparse:
        idx = F.coalesce(F.transform("__cells", lambda c: c["i"]), F.array().cast("array<int>"))
        val = F.coalesce(F.transform("__cells", lambda c: c["v"]), F.array().cast("array<double>"))
        return joined.select("row_id", *keep, _sparse_vector_udf(width)(idx, val).alias("features"))
    as_map = F.map_from_arrays(F.transform("__cells", lambda c: c["i"]), F.transform("__cells", lambda c: c["v"]))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(as_map, i), F.lit(0.0))
    )
    filled = F.when(F.col("__cells").isNull(), F.array_repeat(F.lit(0.0), width)).otherwise(dense)
    return joined.select("row_id", *keep, array_to_vector(filled).alias("features"))


def row_range(rows: DataFrame, start: int, end: int, order: list[str] | None = None) -> DataFrame:
    """P10: rows ``start <= position < end`` (0-based) in ``order`` (default ``row_id``)."""
    from featsift.operators.ranking import sequence_by

    order = order or ["row_id"]
    ranked = sequence_by(rows, order, "__pos")
    return ranked.where((F.col("__pos") > start) & (F.col("__pos") <= end)).drop("__pos")


def from_dense(df: DataFrame, feature_cols: list[str], row_id: str | None = None) -> DataFrame:
    """Long form of a dense frame: ``stack`` the columns; ``feature_id`` = position."""
    n = len(feature_cols)
    pairs = ", ".join(f"{i}L, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(feature_cols))
    keep = [row_id] if row_id else []
    long = df.selectExpr(*keep, f"stack({n}, {pairs}) AS (feature_id, value)")
    if row_id:
        long = long.withColumnRenamed(row_id, "row_id")
    return long.where(F.col("value") != 0)


__all__ = [
    "WideMatrix",
    "join_fitted",
    "shape",
    "prefix_features",
    "gather",
    "drop_features",
    "to_vectors",
    "row_range",
    "from_dense",
]
