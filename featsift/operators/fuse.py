"""Horizontal fusion of feature blocks and the set operations around scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators.matrix import WideMatrix


def fuse_long(blocks: dict[str, WideMatrix], how: str = "inner") -> WideMatrix:
    """J1, long form: ``unionByName`` of the blocks' entries with block-tagged
    feature ids (``name:feature``); no row join is needed for the cells.  The row
    spine is the join of the blocks' spines on ``row_id`` (``inner`` keeps rows
    present in every block, ``left`` keeps the first block's rows)."""
    names = list(blocks)
    entries = None
    rows = None
    for name in names:
        b = blocks[name]
        e = b.entries.select(
            "row_id", F.concat(F.lit(name + ":"), F.col("feature_id").cast("string")).alias("feature_id"), "value"
        )
        entries = e if entries is None else entries.unionByName(e)
        r = b.rows.select("row_id", *[c for c in b.rows.columns if c == "label"])
        if rows is None:
            rows = r
        else:
            rows = rows.join(r.select("row_id"), "row_id", how)
    spine = rows.select("row_id")
    entries = entries.join(spine, "row_id", "left_semi") if how == "inner" else entries
    label = "label" if "label" in rows.columns else None
    return WideMatrix(entries=entries, rows=rows, columns=None, label_col=label)


def fuse_vectors(frames: dict[str, DataFrame], out: str = "features", how: str = "inner") -> DataFrame:
    """J1, vector form: join ``(row_id, features)`` frames on ``row_id`` and
    ``VectorAssembler`` the vector columns (block order = dict order)."""
    from pyspark.ml.feature import VectorAssembler

    names = list(frames)
    joined = None
    for name in names:
        f = frames[name].withColumnRenamed("features", f"__v_{name}")
        joined = f if joined is None else joined.join(f, "row_id", how)
    asm = VectorAssembler(inputCols=[f"__v_{n}" for n in names], outputCol=out, handleInvalid="error")
    return asm.transform(joined).drop(*[f"__v_{n}" for n in names])


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Concatenate scored chunks."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def split_report(all_rows: DataFrame, train: DataFrame, test: DataFrame, key: str = "row_id") -> DataFrame:
    """train = all - test; sizes plus overlap and coverage checks.

    One ``groupBy(key)`` over the tagged union (multiset semantics as
    ``intersect`` / ``exceptAll``), then one aggregate: no join."""
    tagged = (
        all_rows.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__tr"), F.lit(0).alias("__te"))
        .unionByName(train.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__tr"), F.lit(0).alias("__te")))
        .unionByName(test.select(key, F.lit(0).alias("__a"), F.lit(0).alias("__tr"), F.lit(1).alias("__te")))
    )
    per_key = tagged.groupBy(key).agg(F.sum("__a").alias("a"), F.sum("__tr").alias("tr"), F.sum("__te").alias("te"))
    return per_key.agg(
        F.sum("a").cast("long").alias("n_total"),
        F.sum("tr").cast("long").alias("n_train"),
        F.sum("te").cast("long").alias("n_test"),
        F.count_if((F.col("tr") > 0) & (F.col("te") > 0)).cast("long").alias("n_overlap"),
        F.sum(F.greatest(F.col("a") - F.col("tr") - F.col("te"), F.lit(0))).cast("long").alias("n_uncovered"),
    )
