"""Exact global ordering without a single-task bottleneck.

``Window.orderBy(...)`` with no partition moves every row into one task, and
``orderBy(...).limit(k)`` merges ``partitions * k`` rows in one task.  Both are
fine for a bounded handful of rows and wrong for a score table of millions of
features or a row spine of billions of samples.  The primitives here sort with
range partitioning, pin the sorted result with a reliable checkpoint (so the
sampled range bounds cannot change when a lost partition is recomputed), and
turn per-partition counts (at most one row per partition, a proven bound) into
offsets that are broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featsift.session import pin

# Top-k with k at or below this uses Spark's TakeOrderedAndProject / WindowGroupLimit
# (the final task sees at most partitions * k rows); above it the distributed rank.
SMALL_K = 1000
# ... and only while partitions * k stays below this many rows in that final task.
SINGLE_MERGE_ROWS = 2_000_000

_PID = "__pid"
_MID = "__mid"


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def sequence_by(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order`` (which must be a total order)."""
    ordered = df.orderBy(*_cols(order))
    tagged = pin(
        ordered.withColumn(_PID, F.spark_partition_id()).withColumn(_MID, F.monotonically_increasing_id())
    )
    # One row per partition: the broadcast side is bounded by the partition count.
    per_part = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"), F.min(_MID).alias("__m0"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        _PID, "__m0", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    return (
        tagged.join(F.broadcast(offsets), _PID)
        .withColumn(name, (F.col("__off") + F.col(_MID) - F.col("__m0") + 1).cast("long"))
        .drop(_PID, _MID, "__m0", "__off")
    )


def running_sums(
    df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str], rn: str | None = None
) -> DataFrame:
    """Inclusive running sums of ``sums`` (name -> column) over a total ``order``.

    Distributed: a range-partitioned sort, a per-partition running window, and
    broadcast per-partition offsets (one row per partition).
    """
    order_cols = _cols(order)
    tagged = pin(df.orderBy(*order_cols).withColumn(_PID, F.spark_partition_id()))
    local_w = Window.partitionBy(_PID).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    sum_cols = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    local = tagged
    for k, c in sum_cols.items():
        local = local.withColumn(f"__loc_{k}", F.sum(c).over(local_w))
    if rn:
        local = local.withColumn("__loc_rn", F.row_number().over(Window.partitionBy(_PID).orderBy(*order_cols)))
    aggs = [F.sum(c).alias(f"__tot_{k}") for k, c in sum_cols.items()]
    if rn:
        aggs.append(F.count(F.lit(1)).alias("__tot_rn"))
    per_part = tagged.groupBy(_PID).agg(*aggs)
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    keys = list(sum_cols) + (["rn"] if rn else [])
    offsets = per_part.select(
        _PID, *[F.coalesce(F.sum(f"__tot_{k}").over(before), F.lit(0)).alias(f"__off_{k}") for k in keys]
    )
    out = local.join(F.broadcast(offsets), _PID)
    for k in sum_cols:
        out = out.withColumn(k, F.col(f"__off_{k}") + F.col(f"__loc_{k}"))
    if rn:
        out = out.withColumn(rn, (F.col("__off_rn") + F.col("__loc_rn")).cast("long"))
    drop = [_PID] + [f"__loc_{k}" for k in keys] + [f"__off_{k}" for k in keys]
    return out.drop(*drop)


def top_k(df: DataFrame, k: int, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of a total ``order`` with their 1-based ``rank``.

    Small k: TakeOrderedAndProject (bounded by partitions * k) and a rank over
    the at most k survivors.  Large k: exact distributed rank, then a filter.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    order_cols = _cols(order)
    # Upper bound on the input's partitions without planning it (AQE only coalesces).
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")),
                df.sparkSession.sparkContext.defaultParallelism)
    if k <= SMALL_K and k * parts <= SINGLE_MERGE_ROWS:
        head = df.orderBy(*order_cols).limit(k)
        return head.withColumn(rank, F.row_number().over(Window.orderBy(*order_cols)).cast("long"))
    return sequence_by(df, order_cols, rank).where(F.col(rank) <= k)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column | str], rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group.  ``row_number() <= k`` is planned with a
    partial WindowGroupLimit before the shuffle, so a hot group sends at most
    ``k`` rows per map task."""
    if k > SMALL_K:
        raise ValueError(f"per-group k above {SMALL_K} is not supported")
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)
