"""Classification metrics as aggregations (no collect of predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.ranking import running_sums


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Share of rows with ``label == prediction``."""
    return df.agg(F.avg((F.col(label).cast("double") == F.col(pred).cast("double")).cast("double")).alias("accuracy"))


def log_loss(df: DataFrame, label: str = "label", prob: str = "p", eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood, natural log; the probability given to
    the true class is clipped to [eps, 1-eps] (so p = 1 for a 0 row costs -ln eps)."""
    p = F.col(prob).cast("double")
    p_true = F.when(F.col(label) == 1, p).otherwise(F.lit(1.0) - p)
    q = F.least(F.greatest(p_true, F.lit(eps)), F.lit(1.0 - eps))
    return df.agg(F.avg(-F.log(q)).alias("log_loss"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Exact ROC AUC with tied scores given average ranks (Mann-Whitney).

    Group by distinct score (partial aggregation absorbs a hot score), running
    counts over the score order (distributed), then one sum.
    """
    g = df.groupBy(F.col(score).cast("double").alias("__s")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("long")).alias("__pos")
    )
    run = running_sums(g, [F.col("__s")], {"__cum": F.col("__n")})
    # Average 1-based rank of a tied group: rows before it, plus (n + 1) / 2.
    avg_rank = F.col("__cum") - F.col("__n") + (F.col("__n") + F.lit(1)) / F.lit(2.0)
    tot = run.agg(
        F.sum(F.col("__pos") * avg_rank).alias("__rs"),
        F.sum("__pos").cast("double").alias("__np"),
        F.sum("__n").cast("double").alias("__nn"),
    )
    n_pos, n_all = F.col("__np"), F.col("__nn")
    return tot.select(
        ((F.col("__rs") - n_pos * (n_pos + 1) / 2) / (n_pos * (n_all - n_pos))).alias("auc")
    )
