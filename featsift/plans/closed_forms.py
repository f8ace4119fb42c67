"""Queries that hold fitted models, p values and written files against closed forms.

A model fitted on one 0/1 column, an F or chi2 test over three classes and a PCA
with all its axes have results that SQL can compute directly, so the estimators
and sinks the larger queries use are checked by value here.  The 0/1 column is the
token found in as near as possible half of the labelled documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsift.operators import matrix as MX
from featsift.operators import models as MD
from featsift.operators import reduce as RD
from featsift.operators import scores as SC
from featsift.operators import select as SE
from featsift.operators import split as SP
from featsift.operators.ranking import top_k
from featsift.plans import oracle_sql as O
from featsift.plans import pipelines as PL
from featsift.plans.catalog import _SPLIT_BASE, query, r6
from featsift.session import pin, scratch_path
from featsift.sources import sinks, tables as T

# ---------------------------------------------------------------- p values, three classes

_THREE = O.TOKENS.replace("CAST(l.toxic AS INTEGER)", "CAST(l.quality + l.toxic AS INTEGER)")


@query(
    "anova_pvalue_three",
    O.with_(_THREE, O.ANOVA)
    + """SELECT a.feature_id, round(a.f_score, 6) AS f_score,
       round(CASE WHEN a.f_score = CAST('inf' AS DOUBLE) THEN 0.0
                  ELSE pow((tot.n - 3) / (tot.n - 3 + 2 * a.f_score), (tot.n - 3) / 2) END, 6) AS p_value
FROM anova a, tot""",
)
def q_anova_pvalue_three(spark, sf):
    """A8/A9 with three classes (quality + toxic): with two numerator degrees of
    freedom and d in the denominator, p = (d / (d + 2F)) ^ (d / 2)."""
    out = SC.anova_pvalue(T.token_matrix(spark, sf, label="quality + toxic"))
    return out.select("feature_id", r6("f_score").alias("f_score"), r6("p_value").alias("p_value"))


@query(
    "chi2_report_pvalue",
    O.with_(_THREE)
    + """, cls AS (SELECT label, count(*) AS n_c FROM rws GROUP BY label),
tot AS (SELECT CAST(sum(n_c) AS DOUBLE) AS n FROM cls),
t AS (SELECT feature_id, sum(value) AS t FROM entries GROUP BY feature_id),
seen AS (SELECT feature_id, label, sum(value) AS o FROM entries GROUP BY feature_id, label),
o AS (SELECT t.feature_id, cls.n_c / tot.n * t.t AS e, coalesce(seen.o, 0.0) AS o
      FROM t CROSS JOIN cls CROSS JOIN tot LEFT JOIN seen ON seen.feature_id = t.feature_id AND seen.label = cls.label),
c AS (SELECT feature_id, round(sum((o - e) * (o - e) / e), 6) AS chi2 FROM o GROUP BY feature_id),
ranked AS (SELECT cols.feature_id, c.chi2, row_number() OVER (ORDER BY c.chi2 DESC NULLS LAST, cols.feature_id) AS rank
           FROM cols LEFT JOIN c ON cols.feature_id = c.feature_id)
SELECT feature_id, chi2, round(exp(-chi2 / 2), 6) AS p_value, rank FROM ranked WHERE rank <= 20""",
)
def q_chi2_report_pvalue(spark, sf):
    """The twenty best chi2 scores with their p values (three classes: p = exp(-x/2)).
    Scores are rounded before ranking, so that equal ones tie alike everywhere."""
    table = SC.chi2_pvalue_table(T.token_matrix(spark, sf, label="quality + toxic")).withColumn("chi2", r6("chi2"))
    return SE.ranked_report(table, 20, "chi2").select("feature_id", "chi2", r6("p_value").alias("p_value"), "rank")


# ---------------------------------------------------------------- models on one 0/1 column

_HAS = """
has AS (SELECT row_id, label, CAST(row_id IN (SELECT row_id FROM entries WHERE feature_id IN (SELECT feature_id FROM pick)) AS INTEGER) AS x
        FROM rws),
share AS (SELECT x, avg(CAST(label AS DOUBLE)) AS share FROM has GROUP BY x)"""

_SHARES = """
dfq AS (SELECT feature_id, count(*) AS df FROM entries GROUP BY feature_id),
pick AS (SELECT feature_id FROM dfq ORDER BY abs(2 * df - (SELECT count(*) FROM rws)), feature_id LIMIT 1),""" + _HAS

# One boosting round moves a leaf by the mean of the labels taken as -1 and 1.
_STUMP = _SHARES + """,
stump AS (SELECT x, share, 2 * share - 1 AS f, 1 / (1 + exp(-2 * (2 * share - 1))) AS p FROM share)"""

_UNLABELLED_HAS = """
te AS (SELECT doc_id AS row_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
te_has AS (SELECT row_id, CAST(list_contains(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'),
                                             (SELECT feature_id FROM pick)) AS INTEGER) AS x FROM te)"""


def _one_column(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The selected token, as a one-row ``selected`` list, and the labelled vectors of it."""
    m = T.token_matrix(spark, sf)
    n = m.rows.count()
    df = m.entries.groupBy("feature_id").agg(F.abs(F.lit(2) * F.count(F.lit(1)) - F.lit(n)).alias("off"))
    sel = pin(top_k(df, 1, [F.col("off"), F.col("feature_id")]).select("feature_id", F.lit(0).alias("new_index")))
    return sel, pin(MX.to_vectors(MX.gather(m, sel, bound_rows=1), 1))


def _unlabelled_vectors(spark, sf, sel: DataFrame) -> DataFrame:
    return MX.to_vectors(MX.gather(T.token_matrix(spark, sf, "unlabelled", with_columns=False), sel, bound_rows=1), 1)


def _unpenalised(vectors: DataFrame):
    return MD.logistic_regression(vectors.count(), c=float("inf"), tol=1e-12).fit(vectors)


@query(
    "logreg_share",
    O.with_(O.TOKENS, _SHARES)
    + "SELECT row_id, round(share, 4) AS p, CAST(share > 0.5 AS INTEGER) AS label_pred FROM has JOIN share USING (x)",
)
def q_logreg_share(spark, sf):
    """Unpenalised logistic regression on one 0/1 column gives the class share of each value."""
    _, vectors = _one_column(spark, sf)
    out = MD.score(_unpenalised(vectors), vectors, ["row_id"])
    return out.select("row_id", F.round("p", 4).alias("p"), "label_pred")


@query(
    "logreg_penalised",
    O.with_(O.TOKENS, _SHARES).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, k AS (SELECT CAST(count(*) FILTER (x = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (x = 1) AS DOUBLE) AS n1,
                   CAST(sum(label) FILTER (x = 0) AS DOUBLE) AS y0, CAST(sum(label) FILTER (x = 1) AS DOUBLE) AS y1 FROM has),
newton(i, b, w) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, b - (gb * hww - gw * hbw) / (hbb * hww - hbw * hbw), w - (gw * hbb - gb * hbw) / (hbb * hww - hbw * hbw)
  FROM (SELECT i, b, w, n0 * p0 - y0 + n1 * p1 - y1 AS gb, n1 * p1 - y1 + w AS gw,
               n0 * p0 * (1 - p0) + n1 * p1 * (1 - p1) AS hbb, n1 * p1 * (1 - p1) AS hbw, n1 * p1 * (1 - p1) + 1 AS hww
        FROM (SELECT *, 1 / (1 + exp(-b)) AS p0, 1 / (1 + exp(-b - w)) AS p1 FROM newton, k) AS a) AS b WHERE i < 40),
fitted AS (SELECT b, w FROM newton WHERE i = 40)
SELECT row_id, round(1 / (1 + exp(-b - w * x)), 4) AS p, CAST(b + w * x > 0 AS INTEGER) AS label_pred FROM has, fitted""",
)
def q_logreg_penalised(spark, sf):
    """L1 with its penalty (C = 1 on the summed loss, intercept free) on one 0/1 column; the
    SQL runs Newton's steps."""
    _, vectors = _one_column(spark, sf)
    out = MD.score(MD.logistic_regression(vectors.count(), tol=1e-12).fit(vectors), vectors, ["row_id"])
    return out.select("row_id", F.round("p", 4).alias("p"), "label_pred")


@query(
    "logreg_share_replay",
    O.with_(O.TOKENS, _SHARES, _UNLABELLED_HAS)
    + "SELECT row_id, round(share, 4) AS p, CAST(share > 0.5 AS INTEGER) AS label_pred FROM te_has JOIN share USING (x)",
)
def q_logreg_share_replay(spark, sf):
    """The selection and the model of ``logreg_share`` replayed on every unlabelled row."""
    sel, vectors = _one_column(spark, sf)
    out = MD.score(_unpenalised(vectors), _unlabelled_vectors(spark, sf, sel), ["row_id"])
    return out.select("row_id", F.round("p", 4).alias("p"), "label_pred")


@query(
    "submission_csv",
    O.with_(O.TOKENS, _STUMP, _UNLABELLED_HAS)
    + "SELECT row_id AS id, CAST(p > 0.5 AS INTEGER) AS label FROM te_has JOIN stump USING (x)",
)
def q_submission_csv(spark, sf):
    """Ids joined to the predicted labels, written as ``id,label`` CSV and read back."""
    sel, vectors = _one_column(spark, sf)
    model = _stump().fit(vectors)
    path = scratch_path(spark, "submission")
    sinks.write_submission(PL.submission_frame(MD.score(model, _unlabelled_vectors(spark, sf, sel), ["row_id"])), path)
    return spark.read.option("header", True).schema("id long, label int").csv(path)


@query(
    "forest_share",
    O.with_(O.TOKENS.replace("l.toxic", "l.quality"), O.CHI2, """
pick AS (SELECT feature_id FROM chi ORDER BY round(chi2, 6) DESC NULLS LAST, feature_id LIMIT 1)""", _HAS)
    + """, leaf AS (SELECT x, CASE WHEN (SELECT count(DISTINCT share > 0.5) FROM share) = 1
                                  THEN (SELECT avg(CAST(label AS DOUBLE)) FROM has) ELSE share END AS p FROM share)
SELECT row_id, round(p, 6) AS p, CAST(p > 0.5 AS INTEGER) AS label_pred FROM has JOIN leaf USING (x)""",
)
def q_forest_share(spark, sf):
    """L2: one tree of depth 1 over all rows, on the token with the best chi2 for ``quality``.
    Its leaves hold the class shares; leaves that name the same class are one leaf."""
    m = T.token_matrix(spark, sf, label="quality")
    best = SE.ranked_report(SC.chi2_score(m).withColumn("chi2", r6("chi2")), 1, "chi2")
    sel = pin(best.select("feature_id", F.lit(0).alias("new_index")))
    vectors = pin(MX.to_vectors(MX.gather(m, sel, bound_rows=1), 1))
    model = MD.random_forest(num_trees=1, max_depth=1, min_leaf=1, bootstrap=False, subset="all").fit(vectors)
    return MD.score(model, vectors, ["row_id"]).select("row_id", r6("p").alias("p"), "label_pred")


def _stump():
    return MD.gbt_from_xgb(dict(n_estimators=1, max_depth=1))


@query(
    "gbt_stump",
    O.with_(O.TOKENS, _STUMP)
    + "SELECT row_id, round(p, 6) AS p, CAST(p > 0.5 AS INTEGER) AS label_pred FROM has JOIN stump USING (x)",
)
def q_gbt_stump(spark, sf):
    """One boosting round of depth 1."""
    _, vectors = _one_column(spark, sf)
    return MD.score(_stump().fit(vectors), vectors, ["row_id"]).select("row_id", r6("p").alias("p"), "label_pred")


@query(
    "gbt_stump_curve",
    O.with_(O.TOKENS, _STUMP)
    + """SELECT CAST(1 AS INTEGER) AS round, 'train' AS split,
       round(avg(2 * ln(1 + exp(-2 * (2 * label - 1) * f))), 6) AS loss FROM has JOIN stump USING (x)""",
)
def q_gbt_stump_curve(spark, sf):
    """The evaluation log of one boosting round."""
    _, vectors = _one_column(spark, sf)
    curve = MD.eval_curve(_stump().fit(vectors), {"train": vectors})
    return spark.createDataFrame(curve, "round int, split string, loss double").withColumn("loss", r6("loss"))


# ---------------------------------------------------------------- reduced matrices

_SQUARES = """
x AS (SELECT vec_id AS row_id, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def _squared_norm(column: str):
    from pyspark.ml.functions import vector_to_array

    return F.round(F.aggregate(vector_to_array(column), F.lit(0.0), lambda a, v: a + v * v), 4)


def _embedding_vectors(spark, sf) -> tuple[DataFrame, int]:
    from pyspark.ml.functions import array_to_vector

    emb = T.table(spark, sf, "embeddings")
    width = emb.agg(F.max(F.size("embedding"))).first()[0]
    return emb.select(F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), width


@query(
    "pca_energy",
    O.with_(_SQUARES, "mu AS (SELECT j, avg(v) AS m FROM x GROUP BY j)")
    + "SELECT row_id, round(sum((v - m) * (v - m)), 4) AS energy FROM x JOIN mu USING (j) GROUP BY row_id",
)
def q_pca_energy(spark, sf):
    """With every axis kept, a row's squared length in the new axes is that about the mean."""
    vectors, width = _embedding_vectors(spark, sf)
    return RD.pca_project(vectors, RD.pca_fit(vectors, width)).select("row_id", _squared_norm("features").alias("energy"))


_EMB_SPLIT = """
er AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM embeddings),
held AS (SELECT row_id FROM er WHERE rn <= CAST(ceil(0.15 * (SELECT count(*) FROM embeddings)) AS BIGINT))"""


@query(
    "pca_project_energy",
    O.with_(_SQUARES, _EMB_SPLIT, "mu AS (SELECT j, avg(v) AS m FROM x ANTI JOIN held USING (row_id) GROUP BY j)")
    + "SELECT row_id, round(sum((v - m) * (v - m)), 4) AS energy FROM x SEMI JOIN held USING (row_id) JOIN mu USING (j) GROUP BY row_id",
)
def q_pca_project_energy(spark, sf):
    """D2 on held-out rows: axes and mean of the 85 % part, applied to the other 15 %."""
    vectors, width = _embedding_vectors(spark, sf)
    parts = pin(SP.split_random(vectors.select("row_id"), 0.15, 42))
    of = lambda name: vectors.join(parts.where(F.col("split") == name), "row_id", "left_semi")
    out = RD.pca_project(of("test"), RD.pca_fit(of("train"), width))
    return out.select("row_id", _squared_norm("features").alias("energy"))


@query(
    "reduced_roundtrip",
    O.with_(O.TOKENS, O.CHI2)
    + """, ranked AS (SELECT feature_id, row_number() OVER (ORDER BY round(chi2, 6) DESC NULLS LAST, feature_id) AS rank FROM chi),
kept AS (SELECT e.row_id, r.rank - 1 AS new_index FROM entries e JOIN ranked r USING (feature_id) WHERE r.rank <= 300)
SELECT rws.row_id, rws.label, coalesce(list(new_index ORDER BY new_index) FILTER (new_index IS NOT NULL), [])::VARCHAR AS nonzero
FROM rws LEFT JOIN kept ON kept.row_id = rws.row_id GROUP BY rws.row_id, rws.label""",
)
def q_reduced_roundtrip(spark, sf):
    """The 300 best chi2 columns of every labelled row, written as a reduced matrix and read back."""
    from pyspark.ml.functions import vector_to_array

    m = T.token_matrix(spark, sf)
    sel = pin(SE.select_top_k(SC.chi2_score(m).withColumn("chi2", r6("chi2")), 300, "chi2", "rank"))
    path = scratch_path(spark, "reduced")
    sinks.write_reduced(MX.to_vectors(MX.gather(m, sel, bound_rows=300), 300), path)
    cells = vector_to_array("features")
    nonzero = F.filter(F.transform(cells, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return sinks.read_reduced(spark, path).select("row_id", "label", nonzero.cast("string").alias("nonzero"))
