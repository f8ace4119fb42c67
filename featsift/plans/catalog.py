"""The query catalog: one Spark plan per operator of the inventory, each with a
DuckDB twin where SQL can express it.  Every query reads the driver tables of
``sf_dir`` (or what Spark derives from them) in full.

Floating outputs are rounded to six decimals on both sides; signed ones get
``+ 0.0`` in SQL, since DuckDB keeps a negative zero after rounding and Spark
does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsift.plans import oracle_sql as O
from featsift.operators import matrix as MX
from featsift.operators import scores as SC
from featsift.operators import select as SE
from featsift.operators import stats as ST
from featsift.session import pin, scratch_path
from featsift.sources import tables as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- sources


@query(
    "matrix_long",
    O.with_(O.TOKENS) + "SELECT row_id, feature_id, value, label FROM entries",
)
def q_matrix_long(spark, sf):
    """Labelled token matrix in long form."""
    return T.token_matrix(spark, sf).entries.select("row_id", "feature_id", "value", "label")


@query(
    "unlabelled_rows",
    "SELECT d.doc_id AS row_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def q_unlabelled_rows(spark, sf):
    """The test spine = documents without a label."""
    return T.token_matrix(spark, sf, part="unlabelled", with_columns=False).rows


@query(
    "matrix_shape",
    O.with_(O.TOKENS)
    + """SELECT (SELECT count(DISTINCT row_id) FROM rws) AS n_rows,
       (SELECT count(DISTINCT feature_id) FROM cols) AS n_columns,
       (SELECT count(*) FROM entries) AS n_entries""",
)
def q_matrix_shape(spark, sf):
    """Rows, columns, stored entries of the labelled token matrix."""
    return MX.shape(T.token_matrix(spark, sf))


# ---------------------------------------------------------------- scores


@query(
    "anova_f",
    O.with_(O.EMBEDDINGS, O.ANOVA) + "SELECT feature_id, round(f_score, 6) AS f_score FROM anova",
)
def q_anova_f(spark, sf):
    """One-way ANOVA F of each embedding dimension against ten classes."""
    return SC.anova_f(T.embedding_matrix(spark, sf)).select("feature_id", r6("f_score").alias("f_score"))


@query(
    "topk_anova",
    O.with_(O.TOKENS, O.ANOVA)
    + """, ranked AS (
  SELECT feature_id, f_score,
         row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature_id ASC) AS rank FROM anova)
SELECT feature_id, round(f_score, 6) AS f_score, rank, rank - 1 AS new_index FROM ranked WHERE rank <= 100000""",
)
def q_topk_anova(spark, sf):
    """T4: the 100,000 best tokens by F, best first (the reference's k)."""
    sel = SE.select_top_k(SC.anova_f(T.token_matrix(spark, sf)), 100_000, "f_score", "rank")
    return sel.select("feature_id", r6("f_score").alias("f_score"), "rank", "new_index")


# ---------------------------------------------------------------- projections


@query(
    "prefix_features",
    O.with_(O.TOKENS)
    + """SELECT row_id, feature_id, value FROM entries
WHERE feature_id <= (SELECT max(feature_id) FROM (SELECT feature_id FROM cols ORDER BY feature_id LIMIT 10000))""",
)
def q_prefix_features(spark, sf):
    """The first 10,000 columns (column order = token order)."""
    return MX.prefix_features(T.token_matrix(spark, sf), 10_000).entries.select("row_id", "feature_id", "value")


@query(
    "drop_constant_features",
    O.with_(O.TOKENS, O.MOMENTS)
    + "SELECT e.row_id, e.feature_id, e.value FROM entries e WHERE e.feature_id NOT IN (SELECT feature_id FROM mom WHERE std = 0)",
)
def q_drop_constant_features(spark, sf):
    """P3 after A3: delete the zero-std columns of the train matrix."""
    m = T.token_matrix(spark, sf)
    const = ST.constant_features_by_std(m)
    return MX.drop_features(m, const).entries.select("row_id", "feature_id", "value")


# ---------------------------------------------------------------- per-column statistics


@query("feature_std", O.with_(O.TOKENS, O.MOMENTS) + "SELECT feature_id, round(std, 6) AS std FROM mom")
def q_feature_std(spark, sf):
    """A1: population std of every token column (all-zero columns included)."""
    return ST.feature_std(T.token_matrix(spark, sf)).select("feature_id", r6("std").alias("std"))


@query("feature_variance", O.with_(O.EMBEDDINGS, O.MOMENTS) + "SELECT feature_id, round(var, 6) AS var FROM mom")
def q_feature_variance(spark, sf):
    """A2: population variance of every embedding dimension."""
    return ST.feature_variance(T.embedding_matrix(spark, sf)).select("feature_id", r6("var").alias("var"))


@query("nonconstant_features", O.with_(O.TOKENS, O.MOMENTS) + "SELECT feature_id FROM mom WHERE std > 0")
def q_nonconstant_features(spark, sf):
    """A3: kept columns, std > 0."""
    return ST.nonconstant_features(T.token_matrix(spark, sf), 0.0)


@query(
    "constant_by_value",
    O.with_(O.TOKENS, O.MOMENTS) + "SELECT feature_id, min = max AS is_constant FROM mom",
)
def q_constant_by_value(spark, sf):
    """A4: exact constancy per column, zero-aware."""
    return ST.constant_by_value(T.token_matrix(spark, sf))


@query(
    "constant_count",
    O.with_(O.TOKENS, O.MOMENTS)
    + "SELECT CAST(count_if(std = 0) AS BIGINT) AS n_constant, count(*) AS n_columns FROM mom",
)
def q_constant_count(spark, sf):
    """A5: number of zero-std columns."""
    return ST.constant_count(T.token_matrix(spark, sf))


@query("negative_columns", O.with_(O.EMBEDDINGS, O.MOMENTS) + "SELECT feature_id, any_negative AS has_negative FROM mom")
def q_negative_columns(spark, sf):
    """Per embedding dimension, whether a value is negative."""
    return ST.negative_columns(T.embedding_matrix(spark, sf))


@query(
    "negative_column_count",
    O.with_(O.EMBEDDINGS) + "SELECT count(DISTINCT feature_id) AS n_negative_columns FROM entries WHERE value < 0",
)
def q_negative_column_count(spark, sf):
    """Number of columns with a negative value."""
    return ST.negative_column_count(T.embedding_matrix(spark, sf))


@query(
    "scaler_fit",
    O.with_(O.EMBEDDINGS, O.MOMENTS) + "SELECT feature_id, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM mom",
)
def q_scaler_fit(spark, sf):
    """Per-column mean and population std."""
    fit = ST.scaler_fit(T.embedding_matrix(spark, sf))
    return fit.select("feature_id", r6("mean").alias("mean"), r6("std").alias("std"))


# ---------------------------------------------------------------- scores and top-k


@query("chi2_score", O.with_(O.TOKENS, O.CHI2) + "SELECT feature_id, round(chi2, 6) AS chi2 FROM chi")
def q_chi2_score(spark, sf):
    """A10: chi-square score of each token column against ``toxic``."""
    return SC.chi2_score(T.token_matrix(spark, sf)).select("feature_id", r6("chi2").alias("chi2"))


_TOP_CHI = """, ranked AS (
  SELECT feature_id, chi2, row_number() OVER (ORDER BY chi2 DESC NULLS LAST, feature_id ASC) AS rank FROM chi),
best AS (SELECT feature_id, chi2, rank FROM ranked WHERE rank <= 5000),
sel AS (SELECT feature_id, chi2, rank, row_number() OVER (ORDER BY feature_id) - 1 AS new_index FROM best)
"""


@query(
    "selectkbest_chi2",
    O.with_(O.TOKENS, O.CHI2) + _TOP_CHI + "SELECT feature_id, round(chi2, 6) AS chi2, rank, new_index FROM sel",
)
def q_selectkbest_chi2(spark, sf):
    """T5: the 5,000 best tokens by chi2, kept in column order."""
    sel = SE.select_k_best(T.token_matrix(spark, sf), 5000, "chi2", "original")
    return sel.select("feature_id", r6("score").alias("chi2"), "rank", "new_index")


@query(
    "selected_head_tail",
    O.with_(O.TOKENS, O.CHI2)
    + _TOP_CHI
    + """, pos AS (SELECT feature_id, new_index + 1 AS position FROM sel)
SELECT feature_id, position FROM pos WHERE position <= 10 OR position > (SELECT count(*) FROM sel) - 10""",
)
def q_selected_head_tail(spark, sf):
    """First and last ten selected ids (ascending)."""
    sel = SE.select_k_best(T.token_matrix(spark, sf), 5000, "chi2", "original")
    return SE.selected_head_tail(sel, 10)


@query(
    "chi2_report",
    O.with_(O.TOKENS, O.CHI2)
    + """, ranked AS (
  SELECT feature_id, chi2, row_number() OVER (ORDER BY chi2 DESC NULLS LAST, feature_id ASC) AS rank FROM chi)
SELECT feature_id, round(chi2, 6) AS chi2, rank FROM ranked WHERE rank <= 5""",
)
def q_chi2_report(spark, sf):
    """The five best chi2 scores (NaN never first)."""
    rep = SE.ranked_report(SC.chi2_score(T.token_matrix(spark, sf)), 5, "chi2")
    return rep.select("feature_id", r6("chi2").alias("chi2"), "rank")


@query(
    "anova_top20",
    O.with_(O.TOKENS, O.ANOVA)
    + """, ranked AS (
  SELECT feature_id, f_score, row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature_id ASC) AS rank FROM anova)
SELECT feature_id, round(f_score, 6) AS f_score, rank FROM ranked WHERE rank <= 20""",
)
def q_anova_top20(spark, sf):
    """The twenty best F scores (data of the bar chart)."""
    rep = SE.ranked_report(SC.anova_f(T.token_matrix(spark, sf)), 20, "f_score")
    return rep.select("feature_id", r6("f_score").alias("f_score"), "rank")


@query(
    "topk_variance",
    O.with_(O.TOKENS, O.MOMENTS)
    + """, ranked AS (
  SELECT feature_id, var, row_number() OVER (ORDER BY var DESC NULLS LAST, feature_id ASC) AS rank FROM mom),
best AS (SELECT * FROM ranked WHERE rank <= 20000)
SELECT feature_id, round(var, 6) AS var, rank, (SELECT count(*) FROM best) - rank AS new_index FROM best""",
)
def q_topk_variance(spark, sf):
    """The 20,000 highest-variance columns, laid out in ascending variance."""
    m = T.token_matrix(spark, sf)
    sel = SE.select_top_k(ST.feature_variance(m), 20_000, "var", "ascending")
    return sel.select("feature_id", r6("var").alias("var"), "rank", "new_index")


@query(
    "topk_std",
    O.with_(O.TOKENS, O.MOMENTS)
    + """, ranked AS (
  SELECT feature_id, std, row_number() OVER (ORDER BY std DESC NULLS LAST, feature_id ASC) AS rank FROM mom)
SELECT feature_id, round(std, 6) AS std, rank, rank - 1 AS new_index FROM ranked WHERE rank <= 100000""",
)
def q_topk_std(spark, sf):
    """The 100,000 highest-std columns, best first (the reference's k)."""
    sel = SE.select_top_k(ST.feature_std(T.token_matrix(spark, sf)), 100_000, "std", "rank")
    return sel.select("feature_id", r6("std").alias("std"), "rank", "new_index")


@query("anova_pvalue")
def q_anova_pvalue(spark, sf):
    """A9 (rows-only): F and its p value per embedding dimension."""
    t = SC.anova_pvalue(T.embedding_matrix(spark, sf))
    return t.select("feature_id", r6("f_score").alias("f_score"), r6("p_value").alias("p_value"))


@query("chi2_pvalue")
def q_chi2_pvalue(spark, sf):
    """A11 (rows-only): chi2 and its p value per token column."""
    t = SC.chi2_pvalue_table(T.token_matrix(spark, sf))
    return t.select("feature_id", r6("chi2").alias("chi2"), r6("p_value").alias("p_value"))


@query(
    "gather_selected",
    O.with_(O.TOKENS, O.CHI2)
    + """, ranked AS (
  SELECT feature_id, row_number() OVER (ORDER BY chi2 DESC NULLS LAST, feature_id ASC) AS rank FROM chi),
sel AS (SELECT feature_id, rank - 1 AS new_index FROM ranked WHERE rank <= 1000),
test AS (
  SELECT DISTINCT d.doc_id AS row_id, tok AS feature_id
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS tok
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) d
  WHERE tok <> '')
SELECT t.row_id, t.feature_id, s.new_index, CAST(1.0 AS DOUBLE) AS value FROM test t JOIN sel s ON t.feature_id = s.feature_id""",
)
def q_gather_selected(spark, sf):
    """The 1,000 best chi2 columns fitted on train, replayed on the test rows."""
    train = T.token_matrix(spark, sf)
    sel = SE.select_top_k(SC.chi2_score(train), 1000, "chi2", "rank")
    test = T.token_matrix(spark, sf, part="unlabelled", with_columns=False)
    return MX.gather(test, sel, bound_rows=1000).entries.select("row_id", "feature_id", "new_index", "value")


# ---------------------------------------------------------------- metadata and encoding

from featsift.functions.exprs import MISSING, threshold  # noqa: E402
from featsift.operators import encode as EN  # noqa: E402
from featsift.operators import fuse as FU  # noqa: E402
from featsift.operators import metrics as ME  # noqa: E402
from featsift.operators import scale as SCL  # noqa: E402
from featsift.operators import split as SP  # noqa: E402
from featsift.operators.ranking import sequence_by  # noqa: E402

META_COLS = ["lang", "source"]
ORDER_COLS = ["o_orderstatus", "o_orderpriority"]


def raw_order_metadata(spark, sf) -> DataFrame:
    """A metadata frame shaped like the reference's CSV: an id, two columns to
    drop, a blank-header column, and the categorical columns (with nulls)."""
    o = T.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("ID"),
        F.col("o_custkey").cast("string").alias("Organism group"),
        F.col("o_orderdate").alias("Create date"),
        F.col("o_totalprice").alias("Unnamed: 0"),
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("o_orderpriority"),
    )


_OM_OUT = O.with_(O.ORDMETA) + "SELECT ID, o_orderstatus, o_orderpriority FROM om"


@query("metadata_clean", _OM_OUT)
def q_metadata_clean(spark, sf):
    """Drop named and blank-header columns, keep the key."""
    return EN.clean_metadata(raw_order_metadata(spark, sf))


@query("metadata_scan", _OM_OUT)
def q_metadata_scan(spark, sf):
    """The metadata frame written as CSV (nulls as the token ``NA``) into the
    shared scratch folder, read back with a header and the NA tokens normalised."""
    from featsift.session import scratch_path
    from featsift.sources.metadata import read_metadata_csv

    raw = raw_order_metadata(spark, sf).withColumn("o_orderpriority", F.coalesce("o_orderpriority", F.lit("NA")))
    path = scratch_path(spark, "metadata-csv")
    raw.write.option("header", True).csv(path)
    df = read_metadata_csv(spark, path, key="ID", key_type="bigint")
    return EN.clean_metadata(df)


@query(
    "fill_missing", O.with_(O.ORDMETA) + "SELECT ID, o_orderstatus, o_orderpriority FROM omf"
)
def q_fill_missing(spark, sf):
    """Nulls become 'Missing'."""
    return EN.fill_missing(EN.clean_metadata(raw_order_metadata(spark, sf)), ORDER_COLS, MISSING)


_OM_COUNTS = """, ol AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM omf
            UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM omf),
oc AS (SELECT "column", value, count(*) AS n FROM ol WHERE value IS NOT NULL GROUP BY 1, 2)
"""


@query("category_counts", O.with_(O.ORDMETA) + _OM_COUNTS + 'SELECT "column", value, n FROM oc')
def q_category_counts(spark, sf):
    """Value counts of the filled categorical columns."""
    filled = EN.fill_missing(EN.clean_metadata(raw_order_metadata(spark, sf)), ORDER_COLS)
    return ST.category_counts(filled, ORDER_COLS)


@query(
    "top_categories",
    O.with_(O.ORDMETA)
    + _OM_COUNTS
    + """SELECT "column", value, n, rank FROM (SELECT "column", value, n,
   row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rank FROM oc) WHERE rank <= 2""",
)
def q_top_categories(spark, sf):
    """The two most frequent values per column ('Missing' may be one)."""
    filled = EN.fill_missing(EN.clean_metadata(raw_order_metadata(spark, sf)), ORDER_COLS)
    return EN.fit_top_categories(filled, ORDER_COLS, 2)


@query(
    "collapse_rare",
    O.with_(O.DOCMETA, O.DOC_TOP2)
    + """SELECT ID,
  CASE WHEN lang IN (SELECT value FROM top2 WHERE "column" = 'lang') THEN lang ELSE 'Other' END AS lang,
  CASE WHEN source IN (SELECT value FROM top2 WHERE "column" = 'source') THEN source ELSE 'Other' END AS source
FROM tem""",
)
def q_collapse_rare(spark, sf):
    """Top-2 per column fitted on train documents, applied to the test documents."""
    train = T.document_metadata(spark, sf, "labelled")
    test = T.document_metadata(spark, sf, "unlabelled")
    return EN.collapse_rare(test, META_COLS, EN.fit_top_categories(train, META_COLS, 2)).select("ID", *META_COLS)


@query(
    "collapse_rare_refit",
    O.with_(O.DOCMETA, O.DOC_TOP2)
    + """, trc1 AS (SELECT ID,
  CASE WHEN lang IN (SELECT value FROM top2 WHERE "column" = 'lang') THEN lang ELSE 'Other' END AS lang,
  CASE WHEN source IN (SELECT value FROM top2 WHERE "column" = 'source') THEN source ELSE 'Other' END AS source
  FROM trm),
l2 AS (SELECT 'lang' AS "column", lang AS value FROM trc1 UNION ALL SELECT 'source', source FROM trc1),
c2 AS (SELECT "column", value, count(*) AS n FROM l2 GROUP BY 1, 2),
t2 AS (SELECT * FROM (SELECT "column", value, n,
   row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rank FROM c2) WHERE rank <= 2)
SELECT ID,
  CASE WHEN lang IN (SELECT value FROM t2 WHERE "column" = 'lang') THEN lang ELSE 'Other' END AS lang,
  CASE WHEN source IN (SELECT value FROM t2 WHERE "column" = 'source') THEN source ELSE 'Other' END AS source
FROM tem""",
)
def q_collapse_rare_refit(spark, sf):
    """Test list refitted on the collapsed train."""
    train = T.document_metadata(spark, sf, "labelled")
    test = T.document_metadata(spark, sf, "unlabelled")
    _, test_c = EN.collapse_rare_refit(train, test, META_COLS, 2)
    return test_c.select("ID", *META_COLS)


_ONEHOT_TRAIN = """
oh_tr AS (SELECT ID AS row_id, 'lang_' || lang AS feature_id FROM trm WHERE lang IS NOT NULL
          UNION ALL SELECT ID, 'source_' || source FROM trm WHERE source IS NOT NULL),
oh_te AS (SELECT ID AS row_id, 'lang_' || lang AS feature_id FROM tem WHERE lang IS NOT NULL
          UNION ALL SELECT ID, 'source_' || source FROM tem WHERE source IS NOT NULL)"""


@query(
    "one_hot",
    O.with_(O.DOCMETA, _ONEHOT_TRAIN) + "SELECT row_id, feature_id, CAST(1.0 AS DOUBLE) AS value FROM oh_tr",
)
def q_one_hot(spark, sf):
    """One-hot (no level dropped) of the train documents' lang and source, long form."""
    return EN.one_hot_long(T.document_metadata(spark, sf, "labelled"), META_COLS)


@query(
    "align_outer",
    O.with_(O.DOCMETA, _ONEHOT_TRAIN)
    + """, a AS (SELECT DISTINCT feature_id FROM oh_tr), b AS (SELECT DISTINCT feature_id FROM oh_te)
SELECT coalesce(a.feature_id, b.feature_id) AS feature_id, a.feature_id IS NOT NULL AS in_train,
       b.feature_id IS NOT NULL AS in_test FROM a FULL OUTER JOIN b ON a.feature_id = b.feature_id""",
)
def q_align_outer(spark, sf):
    """Outer alignment of the train and test dummy columns."""
    tr = EN.dummy_dictionary(T.document_metadata(spark, sf, "labelled"), META_COLS)
    te = EN.dummy_dictionary(T.document_metadata(spark, sf, "unlabelled"), META_COLS)
    return EN.align_outer(tr, te)


@query(
    "align_to_train",
    O.with_(O.DOCMETA, _ONEHOT_TRAIN)
    + """SELECT row_id, feature_id, CAST(1.0 AS DOUBLE) AS value FROM oh_te
WHERE feature_id IN (SELECT feature_id FROM oh_tr)""",
)
def q_align_to_train(spark, sf):
    """Test dummies reindexed to the train columns (test-only columns dropped)."""
    train = T.document_metadata(spark, sf, "labelled")
    test = T.document_metadata(spark, sf, "unlabelled")
    return EN.align_to_train(EN.one_hot_long(test, META_COLS), EN.dummy_dictionary(train, META_COLS)).select(
        "row_id", "feature_id", "value"
    )


@query(
    "target_stats",
    O.with_(O.DOCMETA, O.DOC_TARGET)
    + 'SELECT "column", value, n, round(y_sum, 6) AS y_sum, round(y_mean, 6) AS y_mean, round(prior, 6) AS prior FROM ts',
)
def q_target_stats(spark, sf):
    """Per category count and label mean, with the prior."""
    st = ST.target_stats(T.document_metadata(spark, sf, "labelled"), META_COLS)
    return st.select("column", "value", "n", *[r6(c).alias(c) for c in ("y_sum", "y_mean", "prior")])


def _te_sql(enc: str) -> str:
    return (
        O.with_(O.DOCMETA, O.DOC_TARGET)
        + f""", enc AS (SELECT "column", value, {enc} AS encoding FROM ts)
SELECT t.ID,
  round(coalesce(el.encoding, (SELECT prior FROM pr)), 6) AS lang,
  round(coalesce(es.encoding, (SELECT prior FROM pr)), 6) AS source
FROM tem t
LEFT JOIN enc el ON el."column" = 'lang' AND el.value = t.lang
LEFT JOIN enc es ON es."column" = 'source' AND es.value = t.source"""
    )


_SIGMOID = (
    "CASE WHEN n = 1 THEN prior ELSE prior * (1.0 - 1.0 / (1.0 + exp(-(CAST(n AS DOUBLE) - 20.0) / 10.0)))"
    " + y_mean * (1.0 / (1.0 + exp(-(CAST(n AS DOUBLE) - 20.0) / 10.0))) END"
)


@query("target_encode", _te_sql(_SIGMOID))
def q_target_encode(spark, sf):
    """Sigmoid-smoothed target encoding (smoothing 10, leaf 20) fitted on
    train documents, applied to test documents; unseen -> prior."""
    train = T.document_metadata(spark, sf, "labelled")
    test = T.document_metadata(spark, sf, "unlabelled")
    fit = EN.fit_target_encoder(train, META_COLS, weighting="sigmoid", smoothing=10.0, min_samples_leaf=20)
    out = EN.apply_target_encoder(test, META_COLS, fit)
    return out.select("ID", *[r6(c).alias(c) for c in META_COLS])


@query("target_encode_count", _te_sql("(y_sum + 10.0 * prior) / (CAST(n AS DOUBLE) + 10.0)"))
def q_target_encode_count(spark, sf):
    """E4 (count weighting, Spark's TargetEncoder form): (Σy + 10·prior)/(n + 10)."""
    train = T.document_metadata(spark, sf, "labelled")
    test = T.document_metadata(spark, sf, "unlabelled")
    fit = EN.fit_target_encoder(train, META_COLS, weighting="count", smoothing=10.0)
    out = EN.apply_target_encoder(test, META_COLS, fit)
    return out.select("ID", *[r6(c).alias(c) for c in META_COLS])


# ---------------------------------------------------------------- scaling, weighting, fusion


@query(
    "standardize",
    O.with_(O.EMBEDDINGS, O.MOMENTS)
    + """SELECT e.row_id, e.feature_id,
  round((e.value - m.mean) / (CASE WHEN m.std = 0 THEN 1.0 ELSE m.std END), 6) + 0.0 AS value
FROM entries e JOIN mom m ON e.feature_id = m.feature_id""",
)
def q_standardize(spark, sf):
    """E5: (x - mean) / std on the dense embedding matrix (population std)."""
    m = T.embedding_matrix(spark, sf)
    z = SCL.standardize_entries(m, ST.scaler_fit(m), bound_rows=64)
    return z.entries.select("row_id", "feature_id", r6("value").alias("value"))


_FUSE_SQL = (
    O.with_(O.TOKENS, O.CHI2, O.DOCMETA)
    + """, ranked AS (
  SELECT feature_id, row_number() OVER (ORDER BY chi2 DESC NULLS LAST, feature_id ASC) AS rank FROM chi),
sel AS (SELECT feature_id FROM ranked WHERE rank <= 100),
tokb AS (SELECT e.row_id, 'tok:' || e.feature_id AS feature_id, e.value FROM entries e JOIN sel s ON e.feature_id = s.feature_id),
metab AS (SELECT ID AS row_id, 'meta:lang_' || lang AS feature_id, CAST(1.0 AS DOUBLE) AS value FROM trm
          UNION ALL SELECT ID, 'meta:source_' || source, CAST(1.0 AS DOUBLE) FROM trm),
nmeta AS (SELECT CAST(count(DISTINCT feature_id) AS DOUBLE) AS k FROM metab)
"""
)


def _fused(spark, sf, weights: bool):
    train = T.token_matrix(spark, sf)
    sel = pin(SE.select_top_k(SC.chi2_score(train), 100, "chi2", "rank").select("feature_id", "new_index"))
    tok = MX.gather(train, sel, bound_rows=100)
    meta_df = T.document_metadata(spark, sf, "labelled")
    meta = MX.WideMatrix(
        entries=EN.one_hot_long(meta_df, META_COLS), rows=meta_df.select(F.col("ID").alias("row_id"), "label")
    )
    if weights:
        n_meta = EN.dummy_dictionary(meta_df, META_COLS).count()
        tok = SCL.weight_block(tok, 0.7, 100)
        meta = SCL.weight_block(meta, 0.3, n_meta)
    return FU.fuse_long({"tok": tok, "meta": meta}, "inner")


@query("fuse_blocks", _FUSE_SQL + "SELECT * FROM tokb UNION ALL SELECT * FROM metab")
def q_fuse_blocks(spark, sf):
    """Token block (top-100 chi2) and one-hot metadata block side by side, by row id."""
    return _fused(spark, sf, False).entries.select("row_id", "feature_id", "value")


@query(
    "weight_blocks",
    _FUSE_SQL
    + """SELECT row_id, feature_id, round(value * 0.7 / 100.0, 6) AS value FROM tokb
UNION ALL SELECT row_id, feature_id, round(value * 0.3 / (SELECT k FROM nmeta), 6) FROM metab""",
)
def q_weight_blocks(spark, sf):
    """Block weights 0.7 (tokens) and 0.3 (metadata), each over its column count."""
    f = _fused(spark, sf, True)
    return f.entries.select("row_id", "feature_id", r6("value").alias("value"))


# ---------------------------------------------------------------- row ranges, chunks, splits

_TEST_RANK = """
te AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) AS pos
       FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""


@query("row_range", O.with_(_TEST_RANK) + "SELECT row_id FROM te WHERE pos > 100 AND pos <= 300")
def q_row_range(spark, sf):
    """P10: test rows at positions [100, 300) in id order."""
    rows = T.token_matrix(spark, sf, part="unlabelled", with_columns=False).rows
    return MX.row_range(rows, 100, 300)


@query("union_chunks", O.with_(_TEST_RANK) + "SELECT row_id, CAST((pos - 1) // 250 AS BIGINT) AS chunk FROM te")
def q_union_chunks(spark, sf):
    """The reference appends scored 10,000-row chunks; here the chunk id is
    arithmetic on the distributed rank (partitions do the chunking, no loop over
    the data), and the append operator joins the labelled-order halves back."""
    rows = T.token_matrix(spark, sf, part="unlabelled", with_columns=False).rows
    ranked = sequence_by(rows, ["row_id"], "pos").withColumn("chunk", F.floor((F.col("pos") - 1) / 250).cast("long"))
    half = (ranked.agg(F.max("chunk")).first()[0] or 0) // 2
    parts = [ranked.where(F.col("chunk") <= half), ranked.where(F.col("chunk") > half)]
    return FU.union_chunks(parts).select("row_id", "chunk")


_SPLIT_BASE = """
lr AS (SELECT doc_id AS row_id, CAST(toxic AS INTEGER) AS label,
              md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM labels)"""


@query(
    "split_random",
    O.with_(_SPLIT_BASE)
    + """, r AS (SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS rn FROM lr)
SELECT row_id, CASE WHEN rn <= CAST(ceil(0.15 * (SELECT count(*) FROM lr)) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def q_split_random(spark, sf):
    """K1: exact 85/15 hold-out of the labelled rows, seed 42."""
    rows = T.token_matrix(spark, sf, with_columns=False).rows.select("row_id")
    return SP.split_random(rows, 0.15, 42)


def _strat_sql(frac: str, src: str, names: tuple[str, str]) -> str:
    return f"""
cc_{names[1]} AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
nn_{names[1]} AS (SELECT sum(n_c) AS n, CAST(ceil({frac} * sum(n_c)) AS BIGINT) AS n_test FROM cc_{names[1]}),
q0_{names[1]} AS (SELECT c.label, c.n_c, (nn.n - nn.n_test) * c.n_c // nn.n AS base,
            (nn.n - nn.n_test) * c.n_c % nn.n AS rem, nn.n - nn.n_test AS n_train
     FROM cc_{names[1]} c, nn_{names[1]} nn),
q1_{names[1]} AS (SELECT label, n_c, base, rem, n_train, row_number() OVER (ORDER BY rem DESC, label) AS rr,
            n_train - sum(base) OVER () AS lft FROM q0_{names[1]}),
qt_{names[1]} AS (SELECT label, n_c - (base + CASE WHEN rr <= lft THEN 1 ELSE 0 END) AS quota FROM q1_{names[1]}),
rk_{names[1]} AS (SELECT s.row_id, s.label, s.h, row_number() OVER (PARTITION BY s.label ORDER BY s.h, s.row_id) AS rn
     FROM {src} s),
sp_{names[1]} AS (SELECT r.row_id, r.label, r.h, CASE WHEN r.rn <= q.quota THEN '{names[1]}' ELSE '{names[0]}' END AS split
     FROM rk_{names[1]} r JOIN qt_{names[1]} q ON r.label = q.label)"""


@query(
    "split_stratified",
    O.with_(_SPLIT_BASE, _strat_sql("0.2", "lr", ("train", "test"))) + "SELECT row_id, label, split FROM sp_test",
)
def q_split_stratified(spark, sf):
    """K2: exact stratified 80/20 on ``toxic``."""
    rows = T.token_matrix(spark, sf, with_columns=False).rows
    return SP.split_stratified(rows, "label", 0.2, 42)


@query(
    "split_three_way",
    O.with_(
        _SPLIT_BASE,
        _strat_sql("0.4", "lr", ("train", "temp")),
        "tmp AS (SELECT row_id, label, h FROM sp_temp WHERE split = 'temp')",
        _strat_sql("0.5", "tmp", ("valid", "test")),
    )
    + "SELECT row_id, label, split FROM sp_temp WHERE split = 'train' UNION ALL SELECT row_id, label, split FROM sp_test",
)
def q_split_three_way(spark, sf):
    """K3: stratified 60/20/20 (train/valid/test)."""
    rows = T.token_matrix(spark, sf, with_columns=False).rows
    return SP.split_three_way(rows, "label", 42)


@query(
    "split_disjoint",
    O.with_(_SPLIT_BASE)
    + """, r AS (SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS rn FROM lr),
s AS (SELECT row_id, rn <= CAST(ceil(0.15 * (SELECT count(*) FROM lr)) AS BIGINT) AS is_test FROM r)
SELECT (SELECT count(*) FROM lr) AS n_total, (SELECT count(*) FROM s WHERE NOT is_test) AS n_train,
       (SELECT count(*) FROM s WHERE is_test) AS n_test, CAST(0 AS BIGINT) AS n_overlap, CAST(0 AS BIGINT) AS n_uncovered""",
)
def q_split_disjoint(spark, sf):
    """train = all - test, checked by intersect and exceptAll."""
    rows = T.token_matrix(spark, sf, with_columns=False).rows.select("row_id")
    s = SP.split_random(rows, 0.15, 42)
    return FU.split_report(rows, s.where(F.col("split") == "train"), s.where(F.col("split") == "test"))


# ---------------------------------------------------------------- thresholds and metrics


def _lineitem_scored(spark, sf) -> DataFrame:
    li = T.table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 10).cast("double").alias("p"),
        (F.col("l_linestatus") == "O").cast("int").alias("y"),
    )


@query(
    "threshold_label",
    O.with_(O.LINEITEM_SCORE)
    + "SELECT l_orderkey, l_linenumber, round(p, 6) AS p, CAST(p > 0.5 AS INTEGER) AS label FROM li",
)
def q_threshold_label(spark, sf):
    """Strict ``p > 0.5`` labels."""
    s = _lineitem_scored(spark, sf)
    return s.select("l_orderkey", "l_linenumber", r6("p").alias("p"), threshold(F.col("p"), 0.5).alias("label"))


@query(
    "metric_accuracy",
    O.with_(O.LINEITEM_SCORE)
    + "SELECT round(avg(CAST(y = CAST(p > 0.5 AS INTEGER) AS DOUBLE)), 6) AS accuracy FROM li",
)
def q_metric_accuracy(spark, sf):
    """Accuracy of ``p > 0.5`` against ``l_linestatus = 'O'``."""
    s = _lineitem_scored(spark, sf).withColumn("prediction", threshold(F.col("p")))
    return ME.accuracy(s, "y", "prediction").select(r6("accuracy").alias("accuracy"))


@query(
    "metric_logloss",
    O.with_(O.LINEITEM_SCORE)
    + """, c AS (SELECT least(greatest(CASE WHEN y = 1 THEN p ELSE 1.0 - p END, 1e-15), 1.0 - 1e-15) AS q FROM li)
SELECT round(avg(-ln(q)), 6) AS log_loss FROM c""",
)
def q_metric_logloss(spark, sf):
    """Log loss with probabilities clipped at 1e-15."""
    return ME.log_loss(_lineitem_scored(spark, sf), "y", "p").select(r6("log_loss").alias("log_loss"))


@query(
    "metric_auc",
    O.with_(O.LINEITEM_SCORE)
    + """, g AS (SELECT p, count(*) AS n, sum(y) AS pos FROM li GROUP BY p),
r AS (SELECT p, n, pos, sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g),
t AS (SELECT sum(pos * (CAST(cum - n AS DOUBLE) + CAST(n + 1 AS DOUBLE) / 2.0)) AS rs,
             CAST(sum(pos) AS DOUBLE) AS np, CAST(sum(n) AS DOUBLE) AS nn FROM r)
SELECT round((rs - np * (np + 1) / 2) / (np * (nn - np)), 6) AS auc FROM t""",
)
def q_metric_auc(spark, sf):
    """Exact ROC AUC (average ranks for ties) of ``p`` against ``y``."""
    return ME.roc_auc(_lineitem_scored(spark, sf), "y", "p").select(r6("auc").alias("auc"))


# ---------------------------------------------------------------- models (rows-only checks)

from featsift.operators import models as MD  # noqa: E402
from featsift.plans import pipelines as PL  # noqa: E402


def _screen(spark, sf, cfg):
    train = T.token_matrix(spark, sf, "labelled")
    test = T.token_matrix(spark, sf, "unlabelled", with_columns=False)
    fitted = PL.fit_screening(train, cfg)
    return fitted, test


def _scored_out(df: DataFrame) -> DataFrame:
    return df.select("row_id", r6("p").alias("p"), "label_pred")


@query("logreg_score")
def q_logreg_score(spark, sf):
    """chi2 top-10,000 -> scale -> logistic regression (C=1, 1000 iterations) -> test scores."""
    fitted, test = _screen(spark, sf, PL.ScreeningConfig("chi2", 10_000, model="logreg", model_params={"max_iter": 1000}))
    return _scored_out(PL.transform_screening(fitted, test))


@query("forest_score")
def q_forest_score(spark, sf):
    """F top-100,000 (the reference's k) -> scale -> random forest (the reference's 200 trees of
    depth 20, sqrt features, leaves of two rows) -> test scores."""
    cfg = PL.ScreeningConfig("anova_f", 100_000, model="forest", model_params={"num_trees": 200, "max_depth": 20, "min_leaf": 2})
    fitted, test = _screen(spark, sf, cfg)
    return _scored_out(PL.transform_screening(fitted, test))


@query("gbt_score")
def q_gbt_score(spark, sf):
    """L3/L4: every column with std > 1e-12 -> variance top-20,000 (ascending layout) -> scale -> boosted
    trees (the reference's 2,000 rounds of depth 4)."""
    params = MD.XGB_PRESETS["wide_2000_shallow"]
    cfg = PL.ScreeningConfig("variance", 20_000, layout="ascending", drop_constant_eps=1e-12,
                             model="gbt", model_params=params)
    fitted, test = _screen(spark, sf, cfg)
    return _scored_out(PL.transform_screening(fitted, test))


# Demo size for boosted trees in ``gbt_early_stop`` and ``gbt_eval_curve`` (the reference trains 3,000 rounds).
MD_PRESET_SMALL = dict(n_estimators=20, learning_rate=0.1, max_depth=4, subsample=0.8, colsample_bytree=0.8)


@query("gbt_early_stop")
def q_gbt_early_stop(spark, sf):
    """Every column with std > 0 -> scale -> 85/15 hold-out -> boosted trees, patience 5 -> test scores."""
    params = dict(MD_PRESET_SMALL, n_estimators=30)
    cfg = PL.ScreeningConfig(None, 0, drop_constant_eps=0.0, model="gbt", model_params=params,
                             holdout=0.15, patience=5)
    fitted, test = _screen(spark, sf, cfg)
    return _scored_out(PL.transform_screening(fitted, test)).withColumn("best_rounds", F.lit(fitted.best_rounds))


@query("gbt_eval_curve")
def q_gbt_eval_curve(spark, sf):
    """Per-round train / valid loss of the boosted model (every column with std > 0, hold-out 0.15)."""
    params = dict(MD_PRESET_SMALL, n_estimators=25)
    cfg = PL.ScreeningConfig(None, 0, drop_constant_eps=0.0, model="gbt", model_params=params, holdout=0.15)
    fitted, _ = _screen(spark, sf, cfg)
    return spark.createDataFrame(fitted.curve, "round int, split string, loss double").select(
        "round", "split", r6("loss").alias("loss")
    )


@query("score_pipeline")
def q_score_pipeline(spark, sf):
    """Fitted F top-10,000 (the reference's k) + scaler + logistic regression replayed on every unlabelled row."""
    cfg = PL.ScreeningConfig("anova_f", 10_000, model="logreg", model_params={"max_iter": 1000})
    fitted, test = _screen(spark, sf, cfg)
    return _scored_out(PL.transform_screening(fitted, test))


@query("submission")
def q_submission(spark, sf):
    """The flagship's ``(id, label)`` table, also written as CSV to the shared scratch folder."""
    path = scratch_path(spark, "submission")
    PL.write_submission(PL.screening_submission(spark, sf), path)
    return spark.read.option("header", True).schema("id long, label int").csv(path)


@query("pca_embeddings")
def q_pca_embeddings(spark, sf):
    """16 principal components of the (centred) embedding rows."""
    from pyspark.ml.functions import vector_to_array

    from featsift.operators import reduce as RD

    emb = T.table(spark, sf, "embeddings")
    from pyspark.ml.functions import array_to_vector

    v = emb.select(F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    fit = RD.pca_fit(v, 16)
    out = RD.pca_project(v, fit)
    return out.select("row_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("pcs"))


@query("pca_project")
def q_pca_project(spark, sf):
    """PCA (250 components) fitted on the labelled rows' token vectors, every column,
    applied to the unlabelled rows."""
    from pyspark.ml.functions import vector_to_array

    _, te, _ = PL.reduced_tokens(spark, sf)
    return te.select("row_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("pcs"))


@query("fused_score")
def q_fused_score(spark, sf):
    """Target-encoded metadata + reduced token matrix -> stratified split -> early-stopped boosting (up to
    2,000 rounds, patience 80) -> p > 0.5."""
    scored, _, best = PL.fused_metadata_scores(spark, sf, "target")
    return _scored_out(scored).withColumn("best_rounds", F.lit(best))


@query("onehot_fused_score")
def q_onehot_fused_score(spark, sf):
    """Top-2 collapse + one-hot + align + 0.3/0.7 block weights + reduced matrix -> early-stopped boosting (up
    to 300 rounds, patience 20) -> p > 0.5."""
    scored, _, best = PL.fused_metadata_scores(spark, sf, "onehot")
    return _scored_out(scored).withColumn("best_rounds", F.lit(best))


@query("pca_wide")
def q_pca_wide(spark, sf):
    """D1/D2 at full width: randomised PCA (the reference's 250 components) of the whole labelled
    token matrix, centred implicitly, applied to the unlabelled rows."""
    from featsift.operators import randomized_pca as RP

    fit = RP.fit(T.token_matrix(spark, sf, with_columns=False), k=250, oversample=10, power_iters=2)
    test = T.token_matrix(spark, sf, "unlabelled", with_columns=False)
    return RP.project(test, fit).select("row_id", F.transform("pcs", lambda x: F.round(x, 6)).alias("pcs"))


@query("metadata_gbt_accuracy")
def q_metadata_gbt_accuracy(spark, sf):
    """Metadata-only chain: collapse -> one-hot -> align -> stratified split -> boosting (the
    preset's 300 rounds) -> accuracy per part."""
    out = PL.metadata_model_accuracy(spark, sf, rounds=300)
    return out.select("split", r6("accuracy").alias("accuracy"), "n")


@query("three_way_report")
def q_three_way_report(spark, sf):
    """60/20/20 chain: target encoding + scaling + reduced matrix -> early-stopped boosting (up
    to 2,000 rounds, patience 80) -> accuracy and log loss on valid and test."""
    out = PL.three_way_report(spark, sf)
    return out.select("split", r6("accuracy").alias("accuracy"), r6("log_loss").alias("log_loss"), "n", "best_rounds")


# ---------------------------------------------------------------- fitted on the train part


def _train_part(spark, sf, stratified: bool):
    m = T.token_matrix(spark, sf)
    s = SP.split_stratified(m.rows, "label", 0.2, 42) if stratified else SP.split_random(m.rows.select("row_id"), 0.15, 42)
    return PL.rows_of(m, s.where(F.col("split") == "train"))


_TRAIN_ONLY = """
, tr AS (SELECT row_id FROM ({split}) WHERE split = 'train'),
rws AS (SELECT r.* FROM rws_all r SEMI JOIN tr USING (row_id)),
entries AS (SELECT e.* FROM entries_all e SEMI JOIN tr USING (row_id))"""


def _on_train(split_fragments: list[str], split: str, *then: str) -> str:
    tokens = O.TOKENS.replace("rws AS", "rws_all AS").replace("entries AS", "entries_all AS")
    head = O.with_(tokens, *split_fragments).rstrip() + _TRAIN_ONLY.format(split=split)
    return head + "".join(",\n" + t.strip() for t in then) + "\n"


_RANDOM_SPLIT = [_SPLIT_BASE, "rr AS (SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS rn FROM lr)"]
_RANDOM_PARTS = ("SELECT row_id, CASE WHEN rn <= CAST(ceil(0.15 * (SELECT count(*) FROM lr)) AS BIGINT)"
                 " THEN 'test' ELSE 'train' END AS split FROM rr")


@query(
    "scaler_fit_train",
    _on_train(_RANDOM_SPLIT, _RANDOM_PARTS, O.MOMENTS)
    + "SELECT feature_id, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM mom",
)
def q_scaler_fit_train(spark, sf):
    """A12 after K1: column means and deviations over the train part of the 85/15 hold-out only."""
    f = ST.scaler_fit(_train_part(spark, sf, False))
    return f.select("feature_id", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "selectkbest_train",
    _on_train([_SPLIT_BASE, _strat_sql("0.2", "lr", ("train", "test"))], "SELECT row_id, split FROM sp_test", O.CHI2)
    + """, ranked AS (
  SELECT feature_id, chi2, row_number() OVER (ORDER BY chi2 DESC NULLS LAST, feature_id ASC) AS rank FROM chi)
SELECT feature_id, round(chi2, 6) AS chi2, rank FROM ranked WHERE rank <= 5000""",
)
def q_selectkbest_train(spark, sf):
    """T5 after K2: the 5,000 best tokens by chi2 over the train part of the stratified split only."""
    sel = SE.select_top_k(SC.chi2_score(_train_part(spark, sf, True)), 5000, "chi2", "rank")
    return sel.select("feature_id", r6("chi2").alias("chi2"), "rank")


@query(
    "chi2_pvalue_three",
    O.with_(O.TOKENS.replace("CAST(l.toxic AS INTEGER)", "CAST(l.quality + l.toxic AS INTEGER)"))
    + """, cls AS (SELECT label, count(*) AS n_c FROM rws GROUP BY label),
tot AS (SELECT CAST(sum(n_c) AS DOUBLE) AS n FROM cls),
t AS (SELECT feature_id, sum(value) AS t FROM entries GROUP BY feature_id),
o AS (SELECT t.feature_id, cls.label, t.t, cls.n_c / tot.n * t.t AS e,
             (SELECT coalesce(sum(x.value), 0.0) FROM entries x WHERE x.feature_id = t.feature_id AND x.label = cls.label) AS o
      FROM t, cls, tot),
c AS (SELECT feature_id, sum((o - e) * (o - e) / e) AS chi2 FROM o GROUP BY feature_id)
SELECT cols.feature_id, round(c.chi2, 6) AS chi2, round(exp(-c.chi2 / 2), 6) AS p_value
FROM cols LEFT JOIN c ON cols.feature_id = c.feature_id""",
)
def q_chi2_pvalue_three(spark, sf):
    """A10/A11 with three classes (quality + toxic): two degrees of freedom, so p = exp(-x/2)."""
    m = T.token_matrix(spark, sf, label="quality + toxic")
    out = SC.chi2_pvalue_table(m)
    return out.select("feature_id", r6("chi2").alias("chi2"), r6("p_value").alias("p_value"))


@query(
    "metadata_subset",
    "SELECT doc_id AS ID, lang FROM documents",
)
def q_metadata_subset(spark, sf):
    """A chosen subset of the metadata columns, beside the key."""
    docs = T.document_metadata(spark, sf, "all")
    return EN.clean_metadata(docs, key="ID", subset=["lang"])


from featsift.plans import boosted, centred, chains, closed_forms, table_models  # noqa: E402,F401  (they register their queries)
