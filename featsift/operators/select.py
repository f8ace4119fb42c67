"""Top-k feature selection and the fitted ``selected(feature_id, new_index)`` list.

Tie-break everywhere: score descending, nulls last, then ``feature_id``
ascending.  A selection is fitted on train and replayed on any matrix with
``matrix.gather``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.matrix import WideMatrix
from featsift.operators.ranking import sequence_by, top_k
from featsift.operators.scores import SCORERS


def _by_score(score: str):
    return [F.col(score).desc_nulls_last(), F.col("feature_id").asc()]


def select_top_k(scores: DataFrame, k: int, score: str = "score", layout: str = "rank") -> DataFrame:
    """(feature_id, <score>, rank, new_index) of the ``k`` best columns.

    ``layout`` sets the column order of the selected block:
    * ``rank``      — best first (``argsort(-s)[:k]``), T3/T4;
    * ``ascending`` — the k best in ascending score (``argsort(s)[-k:]``), T2;
    * ``original``  — ascending ``feature_id`` (``SelectKBest``), T5.
    """
    best = top_k(scores, k, _by_score(score), "rank")
    if layout == "rank":
        return best.withColumn("new_index", F.col("rank") - 1)
    if layout == "ascending":
        n_sel = best.count()
        return best.withColumn("new_index", F.lit(n_sel) - F.col("rank"))
    if layout == "original":
        return sequence_by(best, [F.col("feature_id")], "__pos").withColumn("new_index", F.col("__pos") - 1).drop("__pos")
    raise ValueError(layout)


def select_k_best(m: WideMatrix, k: int, scorer: str = "chi2", layout: str = "original") -> DataFrame:
    """T5 with a pluggable scorer (registry in ``scores.SCORERS``)."""
    return select_top_k(SCORERS[scorer](m), k, "score", layout)


def selected_head_tail(selected: DataFrame, n: int = 10) -> DataFrame:
    """The first and last ``n`` selected ids in ascending id order."""
    ordered = sequence_by(selected.select("feature_id"), [F.col("feature_id")], "position")
    total = ordered.count()
    return ordered.where((F.col("position") <= n) | (F.col("position") > total - n))


def ranked_report(scores: DataFrame, k: int, score: str) -> DataFrame:
    """The ``k`` best scores with their rank (small k, bounded single merge)."""
    return top_k(scores, k, _by_score(score), "rank")


def nonconstant_selection(kept: DataFrame) -> DataFrame:
    """Turn a kept-column list (e.g. ``std > 0``) into ``selected`` in column order."""
    return sequence_by(kept.select("feature_id"), [F.col("feature_id")], "__pos").select(
        "feature_id", (F.col("__pos") - 1).alias("new_index")
    )
