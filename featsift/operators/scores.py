"""Per-feature class-separation scores: one ``groupBy(feature_id)`` with one
set of conditional aggregates per class (class counts come from the row spine,
because zeros are implicit).  Scores follow one contract:

* ANOVA F: ``null`` for a constant column (0/0), ``+inf`` for a column that is
  constant inside every class but not overall (a perfect separator), else
  ``(SSB/(C-1)) / (SSW/(N-C))`` with ``SSB = Σ s_c²/n_c - s²/N`` and
  ``SSW = Σ v² - Σ s_c²/n_c``.  Constancy is decided exactly from min/max, not
  from a difference of sums.
* chi2 (on magnitudes, not a contingency table): ``Σ_c (O_c - E_c)² / E_c`` with
  ``O_c`` the class sum and ``E_c = n_c/N · Σ v``; ``null`` for an all-zero column.

``null`` ranks last everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.functions.pvalues import chi2_pvalue, f_pvalue
from featsift.operators.matrix import WideMatrix, join_fitted

POS_INF = float("inf")


def labelled_entries(m: WideMatrix) -> DataFrame:
    """Entries with the label.  Matrices built from a row table carry it already;
    otherwise join the spine (unique row_id; AQE splits a hot row's partition)."""
    if "label" in m.entries.columns:
        return m.entries
    if not m.label_col:
        raise ValueError("matrix has no label")
    return join_fitted(m.entries, m.rows.select("row_id", F.col(m.label_col).alias("label")), "row_id")


def _class_aggregates(m: WideMatrix, classes: list[int], with_squares: bool) -> DataFrame:
    if m.scan is not None and "label" in m.scan.columns:
        # Single scan: cells of rows outside the matrix are nulled; every spine
        # column still forms a group (its train aggregates are null / zero).
        e, val, inside = m.scan, F.when(F.col("__in"), F.col("value")), F.col("__in")
    else:
        e, val, inside = labelled_entries(m), F.col("value"), F.lit(True)
    aggs = [
        F.count(val).alias("nnz"),
        F.sum(val).alias("s"),
        F.min(val).alias("mn"),
        F.max(val).alias("mx"),
    ]
    for i, c in enumerate(classes):
        inc = inside & (F.col("label") == F.lit(c))
        v = F.when(inc, F.col("value"))
        aggs += [F.sum(v).alias(f"s_{i}"), F.count(v).alias(f"nnz_{i}")]
        if with_squares:
            aggs += [F.min(v).alias(f"mn_{i}"), F.max(v).alias(f"mx_{i}"), F.var_pop(v).alias(f"v_{i}")]
    agg = e.groupBy("feature_id").agg(*aggs)
    if m.columns is not None and not (m.scan is not None and "label" in m.scan.columns):
        agg = m.feature_spine().join(agg, "feature_id", "left")
    return agg


def anova_f(m: WideMatrix, class_counts: dict[int, int] | None = None) -> DataFrame:
    """(feature_id, f_score) for every column of the spine."""
    cc = class_counts or m.class_counts()
    classes = list(cc)
    n = float(sum(cc.values()))
    k = len(classes)
    if k < 2:
        raise ValueError("ANOVA needs at least two classes")
    agg = _class_aggregates(m, classes, with_squares=True)
    nnz = F.coalesce(F.col("nnz"), F.lit(0))
    s = F.coalesce(F.col("s"), F.lit(0.0))
    mean = s / F.lit(n)
    # Stable forms: SSB = Σ n_c (mean_c - mean)²; SSW = Σ_c M2_c where M2_c merges the
    # stored cells' var_pop with the class's implicit zeros (Chan et al.).
    ssb, ssw = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(classes):
        n_c = F.lit(float(cc[c]))
        sc = F.coalesce(F.col(f"s_{i}"), F.lit(0.0))
        nz = F.col(f"nnz_{i}").cast("double")
        d = sc / n_c - mean
        ssb = ssb + n_c * d * d
        m1 = sc / nz
        m2 = F.col(f"v_{i}") * nz + nz * (n_c - nz) / n_c * m1 * m1
        ssw = ssw + F.when(F.coalesce(F.col(f"nnz_{i}"), F.lit(0)) == 0, F.lit(0.0)).otherwise(m2)
    global_const = (nnz == 0) | ((nnz == F.lit(int(n))) & (F.col("mn") == F.col("mx")))
    within_const = F.lit(True)
    for i, c in enumerate(classes):
        nz = F.coalesce(F.col(f"nnz_{i}"), F.lit(0))
        within_const = within_const & (
            (nz == 0) | ((nz == F.lit(cc[c])) & (F.col(f"mn_{i}") == F.col(f"mx_{i}")))
        )
    f = (ssb / F.lit(float(k - 1))) / (ssw / F.lit(n - k))
    score = (
        F.when(global_const, F.lit(None).cast("double"))
        .when(within_const, F.lit(POS_INF))
        .when(ssw <= 0, F.lit(None).cast("double"))
        .otherwise(f)
    )
    return agg.select("feature_id", score.alias("f_score"))


def anova_pvalue(m: WideMatrix, class_counts: dict[int, int] | None = None) -> DataFrame:
    """(feature_id, f_score, p_value): survival of F(C-1, N-C)."""
    cc = class_counts or m.class_counts()
    n, k = sum(cc.values()), len(cc)
    f = anova_f(m, cc)
    return f.select("feature_id", "f_score", f_pvalue(F.col("f_score"), k - 1, n - k).alias("p_value"))


def chi2_score(m: WideMatrix, class_counts: dict[int, int] | None = None, reject_negative: bool = False) -> DataFrame:
    """A10: (feature_id, chi2) for every column of the spine; inputs must be non-negative.
    ``reject_negative``: a negative cell fails the query (the registered scorer sets it)."""
    cc = class_counts or m.class_counts()
    classes = list(cc)
    n = float(sum(cc.values()))
    agg = _class_aggregates(m, classes, with_squares=False)
    t = F.coalesce(F.col("s"), F.lit(0.0))
    total = F.lit(0.0)
    for i, c in enumerate(classes):
        obs = F.coalesce(F.col(f"s_{i}"), F.lit(0.0))
        exp = F.lit(float(cc[c])) / F.lit(n) * t
        total = total + (obs - exp) * (obs - exp) / exp
    # P12 without a pass of its own: a negative cell fails the query.
    negative = F.raise_error(F.concat(F.lit("chi2 needs non-negative values: column "), F.col("feature_id").cast("string"))).cast("double")
    score = F.when(t == 0, F.lit(None).cast("double")).otherwise(total)
    if reject_negative:
        score = F.when(F.col("mn") < 0, negative).otherwise(score)
    return agg.select("feature_id", score.alias("chi2"))


def chi2_pvalue_table(m: WideMatrix, class_counts: dict[int, int] | None = None) -> DataFrame:
    """(feature_id, chi2, p_value) with C-1 degrees of freedom."""
    cc = class_counts or m.class_counts()
    sc = chi2_score(m, cc)
    return sc.select("feature_id", "chi2", chi2_pvalue(F.col("chi2"), len(cc) - 1).alias("p_value"))


def _variance_scorer(m: WideMatrix) -> DataFrame:
    from featsift.operators.stats import column_moments

    return column_moments(m).select("feature_id", F.col("var").alias("score"))


def _std_scorer(m: WideMatrix) -> DataFrame:
    from featsift.operators.stats import column_moments

    return column_moments(m).select("feature_id", F.col("std").alias("score"))


# Scorer registry: name -> (matrix) -> DataFrame(feature_id, score); open to user functions.
SCORERS: dict[str, Callable[[WideMatrix], DataFrame]] = {
    "variance": _variance_scorer,
    "std": _std_scorer,
    "anova_f": lambda m: anova_f(m).withColumnRenamed("f_score", "score"),
    "chi2": lambda m: chi2_score(m, reject_negative=True).withColumnRenamed("chi2", "score"),
}


def register_scorer(name: str, fn: Callable[[WideMatrix], DataFrame]) -> None:
    SCORERS[name] = fn
