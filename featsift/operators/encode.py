"""Categorical metadata: cleaning, missing fill, rare-category collapse,
one-hot, train/test alignment and smoothed target encoding.

Fitted states are small tables: the top categories (at most ``k`` per
column), the dummy dictionary, the target statistics per category.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.functions.exprs import MISSING, OTHER
from featsift.operators.ranking import top_k_per_group
from featsift.operators.stats import category_counts

# Columns the reference drops from its metadata, and the blank-header patterns.
DROP_COLUMNS = ["Organism group", "ID", "Create date"]
BLANK_HEADER = re.compile(r"^Unnamed|^_c\d+$")


def clean_metadata(df: DataFrame, key: str | None = "ID", drop: list[str] | None = None,
                   subset: list[str] | None = None) -> DataFrame:
    """Drop the listed columns if present (the key is kept as the join
    key), drop blank-header columns, optionally keep a subset."""
    drop = DROP_COLUMNS if drop is None else drop
    keep = []
    for c in df.columns:
        if c == key:
            keep.append(c)
        elif c in drop or BLANK_HEADER.search(c):
            continue
        elif subset is None or c in subset:
            keep.append(c)
    return df.select(*[F.col(f"`{c}`") for c in keep])


def fill_missing(df: DataFrame, cols: list[str], value: str = MISSING) -> DataFrame:
    """Nulls of ``cols`` become ``value``."""
    return df.fillna(value, subset=cols)


def fit_top_categories(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """The ``k`` most frequent values of each column -> (column, value, n, rank).
    Ties: count descending, then value ascending."""
    counts = category_counts(df, cols)
    return top_k_per_group(counts, ["column"], k, [F.col("n").desc(), F.col("value").asc()])


def _levels(fitted: DataFrame, cols: list[str], bound: int = 10_000) -> dict[str, list[str]]:
    rows = fitted.select("column", "value").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError("fitted category list larger than expected")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out.setdefault(r["column"], []).append(r["value"])
    return out


def collapse_rare(df: DataFrame, cols: list[str], top: DataFrame, other: str = OTHER) -> DataFrame:
    """Keep the fitted top values of each column, others become ``other``.
    The fitted list holds at most k values per column, so it is inlined."""
    levels = _levels(top, cols)
    out = df
    for c in cols:
        keep = levels.get(c, [])
        col = F.col(f"`{c}`")
        out = out.withColumn(c, F.when(col.isin(keep), col).otherwise(F.lit(other)) if keep else F.lit(other))
    return out


def collapse_rare_refit(train: DataFrame, test: DataFrame, cols: list[str], k: int = 2):
    """The test list is refitted on the *collapsed* train, so ``Other`` can
    be one of the k (train's 2nd value may map to ``Other`` on test)."""
    first = fit_top_categories(train, cols, k)
    train_c = collapse_rare(train, cols, first)
    second = fit_top_categories(train_c, cols, k)
    return train_c, collapse_rare(test, cols, second)


def one_hot_long(df: DataFrame, cols: list[str], key: str = "ID") -> DataFrame:
    """E3, long form: one entry ``(row_id, feature_id = column_value, 1.0)`` per
    non-null cell; no level is dropped, nulls give no entry (all-zero)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"`{key}` AS row_id", f"stack({len(cols)}, {pairs}) AS (`column`, value)")
    return long.where(F.col("value").isNotNull()).select(
        "row_id", F.concat_ws("_", "column", "value").alias("feature_id"), F.lit(1.0).alias("value")
    )


def dummy_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """The dummy columns a frame produces: (feature_id, column, value)."""
    return category_counts(df, cols).select(
        F.concat_ws("_", "column", "value").alias("feature_id"), "column", "value"
    )


def one_hot_frame(df: DataFrame, cols: list[str], dictionary: DataFrame, max_levels: int = 1000) -> DataFrame:
    """E3, frame form (``get_dummies``): other columns pass through, then one
    0/1 column per dictionary entry, sorted by name.  Narrow projection, no
    shuffle; the dictionary is bounded by ``max_levels``."""
    rows = dictionary.select("feature_id", "column", "value").limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} dummy columns: use one_hot_long")
    rows = sorted(rows, key=lambda r: r["feature_id"])
    passthrough = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    dummies = [
        F.coalesce((F.col(f"`{r['column']}`").cast("string") == F.lit(r["value"])).cast("int"), F.lit(0)).alias(
            r["feature_id"]
        )
        for r in rows
    ]
    return df.select(*passthrough, *dummies)


def align_outer(train_dict: DataFrame, test_dict: DataFrame) -> DataFrame:
    """Union of the two dummy dictionaries -> (feature_id, in_train, in_test)."""
    a = train_dict.select("feature_id").distinct().withColumn("in_train", F.lit(True))
    b = test_dict.select("feature_id").distinct().withColumn("in_test", F.lit(True))
    return a.join(b, "feature_id", "full").select(
        "feature_id",
        F.coalesce(F.col("in_train"), F.lit(False)).alias("in_train"),
        F.coalesce(F.col("in_test"), F.lit(False)).alias("in_test"),
    )


def align_to_train(test_entries: DataFrame, train_dict: DataFrame) -> DataFrame:
    """Keep the test entries whose dummy column exists on train (test-only
    columns are dropped; train-only columns are implicit zeros)."""
    return test_entries.join(train_dict.select("feature_id").distinct(), "feature_id", "left_semi")


def fit_target_encoder(df: DataFrame, cols: list[str], label: str = "label", weighting: str = "sigmoid",
                       smoothing: float = 10.0, min_samples_leaf: int = 20,
                       single_to_prior: bool = True) -> DataFrame:
    """E4 fit: (column, value, encoding, prior).

    * ``sigmoid`` (the reference's encoder): w = 1/(1+exp(-(n-leaf)/smoothing)),
      enc = prior·(1-w) + mean·w; a category seen once gets the prior.
    * ``count`` (Spark's TargetEncoder): enc = (Σy + smoothing·prior)/(n + smoothing).
    """
    from featsift.operators.stats import target_stats

    st = target_stats(df, cols, label)
    n = F.col("n").cast("double")
    if weighting == "sigmoid":
        w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - F.lit(float(min_samples_leaf))) / F.lit(float(smoothing))))
        enc = F.col("prior") * (F.lit(1.0) - w) + F.col("y_mean") * w
        if single_to_prior:
            enc = F.when(F.col("n") == 1, F.col("prior")).otherwise(enc)
    elif weighting == "count":
        enc = (F.col("y_sum") + F.lit(float(smoothing)) * F.col("prior")) / (n + F.lit(float(smoothing)))
    else:
        raise ValueError(weighting)
    from featsift.session import pin

    # Computed once, reused by every column's lookup and by train and test.
    return pin(st.select("column", "value", enc.alias("encoding"), "prior"))


def apply_target_encoder(df: DataFrame, cols: list[str], fitted: DataFrame, suffix: str = "") -> DataFrame:
    """Per column, left join the fitted dictionary; unseen or null -> prior.

    The dictionary (one row per category) is counted: at most
    ``BROADCAST_ROWS`` it is broadcast, so a hot category on the big side never
    meets a shuffle; above that the planner shuffles and AQE splits skew."""
    from featsift.operators.matrix import BROADCAST_ROWS

    prior = fitted.select("prior").limit(1).collect()
    prior_v = float(prior[0][0]) if prior else 0.0
    small = fitted.count() <= BROADCAST_ROWS
    out = df
    for c in cols:
        d = fitted.where(F.col("column") == c).select(
            F.col("value").alias(f"__v_{c}"), F.col("encoding").alias(f"__e_{c}")
        )
        d = F.broadcast(d) if small else d
        out = out.join(d, F.col(f"`{c}`").cast("string") == F.col(f"__v_{c}"), "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col(f"__e_{c}"), F.lit(prior_v))).drop(f"__v_{c}", f"__e_{c}")
    return out
