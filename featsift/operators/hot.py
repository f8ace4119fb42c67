"""Joins on a column with very frequent keys (a token that stands in every document).

A frequent-item sketch finds every key that fills more than a given share of the rows.
These few keys never enter the shuffle: their rows meet a broadcast of their fitted
rows where they are, and the rest, where no key is frequent, is hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.session import pin

SKETCH_ITEMS = 2**18  # most items a sketch tracks
SKETCH_GROUPS = 64  # sketches are merged in two levels


def hot_share(df: DataFrame) -> float:
    """A quarter of an even shuffle partition, the share above which a key counts as hot."""
    return 1.0 / (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """``(key)``: every non-null key in more than ``share`` of the rows (some with a little
    less may come along), at most ``2 / share`` of them.  One pass and one sketch a
    partition; a sketch's count is never below the true one."""
    share = max(hot_share(df) if share is None else share, 8.0 / SKETCH_ITEMS)
    if not 0.0 < share <= 1.0:
        raise ValueError("share must lie in (0, 1]")
    tracked = min(SKETCH_ITEMS, max(1024, int(8 / share)))
    rows = df.select(F.col(key).alias("k"), (F.spark_partition_id() % SKETCH_GROUPS).alias("part")).where("k IS NOT NULL")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("sketch"))
    parts = pin(parts)  # at most SKETCH_GROUPS rows
    if parts.isEmpty():
        return df.select(key).limit(0)
    whole = parts.agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    top = whole.where("n > 0").select("n", F.expr(f"inline(approx_top_k_estimate(sketch, {min(tracked, int(2 / share) + 1)}))"))
    return pin(top.where(F.col("count") > F.col("n") * F.lit(share)).select(F.col("item").alias(key)))


def join_apart(big: DataFrame, fitted: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``big.join(fitted, key, how)`` (inner, left, left_semi or left_anti) for a ``fitted``
    with one row for each key.  ``hot``: the frequent keys of ``big``, as of ``hot_keys``.
    ``big`` is read twice (and once for its sketch): store it first if it is costly.
    Null keys match nothing and stay where they are too."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no join apart for {how!r}")
    hot = hot_keys(big, key) if hot is None else hot
    flagged = F.broadcast(hot.select(key, F.lit(True).alias("__hot")))
    still = F.col("__hot").isNotNull() | F.col(key).isNull()
    cells = big.join(flagged, key, "left")
    few = F.broadcast(fitted.join(F.broadcast(hot), key, "left_semi"))
    many = fitted.join(F.broadcast(hot), key, "left_anti")
    apart = cells.where(still).drop("__hot").join(few, key, how)
    rest = cells.where(~still).drop("__hot").join(many, key, how)
    return apart.unionByName(rest)
