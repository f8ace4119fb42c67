"""Build the long matrices and metadata frames from the driver's parquet tables.

* Token matrix: ``documents`` -> token presence, ``row_id = doc_id``,
  ``feature_id = token`` (lower-cased ``[a-z]+`` runs), ``value = 1.0``.
  The label comes from ``labels`` (``toxic`` by default).  The label is joined
  at the document level (one row per document, unique key) before the explode,
  so no join ever runs on the exploded, token-skewed side.
* Embedding matrix: ``embeddings`` -> ``posexplode``, ``feature_id`` = position.
* Dense tall matrix: ``lineitem`` numerics, label ``l_linestatus = 'O'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsift.operators.matrix import WideMatrix

# The token pattern shared with the SQL oracle.
TOKEN_SPLIT = "[^a-z]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Scan-parallelism floor for CPU-heavy per-row work (tokenising whole texts).

    A large table arrives in many file splits and is left alone; a table that
    is a single row group (one task) is spread round-robin over the default
    parallelism before the heavy projection.  No key, so no skew.  Call it on a
    bare scan: counting the partitions of a scan is file listing only, while on
    a plan with a join or shuffle it would execute those stages.
    """
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def doc_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token): distinct tokens per document, whole text, no shuffle."""
    return (
        docs.select(
            "doc_id", F.explode(F.array_distinct(F.split(F.lower(F.col("text")), TOKEN_SPLIT))).alias("token")
        ).where(F.col("token") != "")
    )


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of every document, spread before any join."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column spine of the token matrix: every token of every document (train and test)."""
    docs = documents_text(spark, sf_dir)
    return doc_tokens(docs).select(F.col("token").alias("feature_id")).distinct()


def token_matrix(
    spark: SparkSession, sf_dir: str, part: str = "labelled", label: str = "toxic", with_columns: bool = True
) -> WideMatrix:
    """Token-presence matrix of the labelled (train), unlabelled (test) or all documents."""
    docs = documents_text(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr(label).cast("int").alias("label"))
    if part == "labelled":
        docs = docs.join(labels, "doc_id")
    elif part == "unlabelled":
        docs = docs.join(labels, "doc_id", "left_anti")
    elif part != "all":
        raise ValueError(part)
    carry = ["label"] if part == "labelled" else []
    tokens = docs.select(
        "doc_id", *carry, F.explode(F.array_distinct(F.split(F.lower(F.col("text")), TOKEN_SPLIT))).alias("token")
    ).where(F.col("token") != "")
    entries = tokens.select(
        F.col("doc_id").alias("row_id"), F.col("token").alias("feature_id"), F.lit(1.0).alias("value"), *carry
    )
    rows = docs.select(F.col("doc_id").alias("row_id"), *(["label"] if part == "labelled" else []))
    scan = None
    if with_columns and part == "labelled":
        # Statistics read one tokenisation of all documents: the label rides along
        # (null for test rows), so the column spine and the train cells come from
        # the same scan and the same groupBy.  Gathers keep using ``entries``.
        alld = documents_text(spark, sf_dir).join(labels, "doc_id", "left")
        scan = alld.select(
            F.col("doc_id").alias("row_id"), "label",
            F.explode(F.array_distinct(F.split(F.lower(F.col("text")), TOKEN_SPLIT))).alias("feature_id"),
        ).where(F.col("feature_id") != "").select(
            "row_id", "feature_id", F.lit(1.0).alias("value"), "label", F.col("label").isNotNull().alias("__in")
        )
        cols = scan.select("feature_id").distinct()
    else:
        cols = token_columns(spark, sf_dir) if with_columns else None
    return WideMatrix(entries=entries, rows=rows, columns=cols, label_col="label" if part == "labelled" else None,
                      scan=scan)


def embedding_matrix(spark: SparkSession, sf_dir: str, binary: bool = False) -> WideMatrix:
    """Dense 64-wide signed matrix, ten classes (or ``label < 5`` when binary)."""
    emb = table(spark, sf_dir, "embeddings")
    lab = (F.col("label") < 5).cast("int") if binary else F.col("label").cast("int")
    entries = (
        emb.select(F.col("vec_id").alias("row_id"), lab.alias("label"), F.posexplode("embedding").alias("pos", "v"))
        .select(
            "row_id", F.col("pos").cast("long").alias("feature_id"), F.col("v").cast("double").alias("value"), "label"
        )
        .where(F.col("value") != 0)
    )
    rows = emb.select(F.col("vec_id").alias("row_id"), lab.alias("label"))
    width = emb.select(F.max(F.size("embedding"))).first()[0] or 0
    cols = spark.range(width).select(F.col("id").alias("feature_id"))
    return WideMatrix(entries=entries, rows=rows, columns=cols, label_col="label")


# Dense lineitem features in column order.
LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall dense frame: four numeric features and ``label = (l_linestatus = 'O')``.
    ``(l_orderkey, l_linenumber)`` is not unique, so this frame has no row id."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINEITEM_FEATURES, (F.col("l_linestatus") == "O").cast("int").alias("label"))


def document_metadata(spark: SparkSession, sf_dir: str, part: str = "labelled", label: str = "toxic") -> DataFrame:
    """Categorical metadata keyed by ``ID``: ``lang``, ``source`` (+ ``label`` for train)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ID"), "lang", "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ID"), F.col(label).cast("int").alias("label"))
    if part == "labelled":
        return docs.join(labels, "ID")
    if part == "unlabelled":
        return docs.join(labels, "ID", "left_anti")
    return docs


def order_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with nulls: ``o_orderpriority`` '4-NOT SPECIFIED' becomes null."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ID"),
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
