"""Shared DuckDB SQL fragments for the oracle side of the query catalog.

Each fragment mirrors a Spark source in ``featsift.sources.tables``.  Only
ANSI/DuckDB SQL over the pre-registered driver views; outputs cast and rounded
to six decimals exactly as the Spark queries are.
"""

# Labelled token matrix: entries(row_id, label, feature_id, value), rws(row_id, label), cols(feature_id).
TOKENS = """
lab AS (
  SELECT d.doc_id AS row_id, d.text AS text, CAST(l.toxic AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
rws AS (SELECT row_id, label FROM lab),
entries AS (
  SELECT DISTINCT row_id, label, tok AS feature_id, CAST(1.0 AS DOUBLE) AS value
  FROM (SELECT row_id, label, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS tok FROM lab)
  WHERE tok <> ''
),
cols AS (
  SELECT DISTINCT tok AS feature_id
  FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS tok FROM documents)
  WHERE tok <> ''
)"""

# Embedding matrix, ten classes: entries(row_id, label, feature_id, value), rws, cols.
EMBEDDINGS = """
rws AS (SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label FROM embeddings),
entries AS (
  SELECT row_id, label, feature_id, value FROM (
    SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label,
           CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS feature_id,
           CAST(unnest(embedding) AS DOUBLE) AS value
    FROM embeddings)
  WHERE value <> 0
),
cols AS (SELECT CAST(range AS BIGINT) AS feature_id FROM range((SELECT max(len(embedding)) FROM embeddings)))"""

EMBEDDINGS_BINARY = EMBEDDINGS.replace(
    "CAST(label AS INTEGER) AS label FROM embeddings)", "CAST(label < 5 AS INTEGER) AS label FROM embeddings)"
).replace("CAST(label AS INTEGER) AS label,", "CAST(label < 5 AS INTEGER) AS label,")

# Column moments with implicit zeros over cols; needs entries, rws, cols.
MOMENTS = """
nrows AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM rws),
agg AS (
  SELECT feature_id, count(*) AS nnz, sum(value) AS total, avg(value) AS m1, var_pop(value) AS v1,
         min(value) AS mn, max(value) AS mx, max(CAST(value < 0 AS INTEGER)) AS neg
  FROM entries GROUP BY feature_id
),
mom0 AS (
  SELECT c.feature_id, CAST(coalesce(a.nnz, 0) AS BIGINT) AS nnz, coalesce(a.total, 0.0) AS total,
         a.m1, a.v1, a.mn, a.mx, coalesce(a.neg, 0) AS neg, nrows.n AS n
  FROM cols c LEFT JOIN agg a ON c.feature_id = a.feature_id, nrows
),
mom AS (
  SELECT feature_id, nnz, total, total / n AS mean,
         (CASE WHEN nnz = 0 THEN 0.0 ELSE v1 * nnz + nnz * (n - nnz) / n * m1 * m1 END) / n AS var,
         sqrt((CASE WHEN nnz = 0 THEN 0.0 ELSE v1 * nnz + nnz * (n - nnz) / n * m1 * m1 END) / n) AS std,
         CASE WHEN nnz = 0 THEN 0.0 WHEN nnz < n THEN least(mn, 0.0) ELSE mn END AS min,
         CASE WHEN nnz = 0 THEN 0.0 WHEN nnz < n THEN greatest(mx, 0.0) ELSE mx END AS max,
         neg = 1 AS any_negative
  FROM mom0
)"""

# ANOVA F per feature over cols; needs entries, rws, cols.  Output anova(feature_id, f_score).
# SSB = Σ n_c (mean_c - mean)² (absent classes add n_c mean²); SSW = Σ_c M2_c (var_pop merged with zeros).
ANOVA = """
cls AS (SELECT label, count(*) AS n_c FROM rws GROUP BY label),
tot AS (SELECT CAST(sum(n_c) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k FROM cls),
fc AS (
  SELECT e.feature_id, e.label, sum(value) AS s_c, count(*) AS nnz_c, min(value) AS mn_c, max(value) AS mx_c,
         var_pop(value) AS v_c, CAST(cls.n_c AS DOUBLE) AS n_c
  FROM entries e JOIN cls ON e.label = cls.label GROUP BY e.feature_id, e.label, cls.n_c
),
f0 AS (SELECT feature_id, sum(s_c) AS s, sum(n_c) AS n_present FROM fc GROUP BY feature_id),
fa AS (
  SELECT fc.feature_id, sum(fc.nnz_c) AS nnz, min(fc.mn_c) AS mn, max(fc.mx_c) AS mx,
         sum(fc.n_c * (fc.s_c / fc.n_c - f0.s / tot.n) * (fc.s_c / fc.n_c - f0.s / tot.n))
           + (tot.n - f0.n_present) * (f0.s / tot.n) * (f0.s / tot.n) AS ssb,
         sum(fc.v_c * fc.nnz_c + fc.nnz_c * (fc.n_c - fc.nnz_c) / fc.n_c * (fc.s_c / fc.nnz_c) * (fc.s_c / fc.nnz_c)) AS ssw,
         bool_and(fc.nnz_c = fc.n_c AND fc.mn_c = fc.mx_c) AS within_const
  FROM fc JOIN f0 ON fc.feature_id = f0.feature_id, tot
  GROUP BY fc.feature_id, f0.s, f0.n_present, tot.n
),
anova AS (
  SELECT c.feature_id,
    CASE
      WHEN fa.nnz IS NULL OR (fa.nnz = tot.n AND fa.mn = fa.mx) THEN NULL
      WHEN fa.within_const THEN CAST('inf' AS DOUBLE)
      WHEN fa.ssw <= 0 THEN NULL
      ELSE (fa.ssb / (tot.k - 1)) / (fa.ssw / (tot.n - tot.k))
    END AS f_score
  FROM cols c LEFT JOIN fa ON c.feature_id = fa.feature_id, tot
)"""

# chi2 per feature over cols, binary labels 0/1; needs entries, rws, cols.  Output chi(feature_id, chi2).
CHI2 = """
cls AS (SELECT label, count(*) AS n_c FROM rws GROUP BY label),
tot AS (SELECT CAST(sum(n_c) AS DOUBLE) AS n,
               CAST(sum(CASE WHEN label = 0 THEN n_c ELSE 0 END) AS DOUBLE) AS n0,
               CAST(sum(CASE WHEN label = 1 THEN n_c ELSE 0 END) AS DOUBLE) AS n1 FROM cls),
ca AS (
  SELECT feature_id, sum(value) AS t,
         coalesce(sum(CASE WHEN label = 0 THEN value END), 0.0) AS o0,
         coalesce(sum(CASE WHEN label = 1 THEN value END), 0.0) AS o1
  FROM entries GROUP BY feature_id
),
chi AS (
  SELECT c.feature_id,
    CASE WHEN ca.t IS NULL OR ca.t = 0 THEN NULL ELSE
      0.0 + (ca.o0 - tot.n0 / tot.n * ca.t) * (ca.o0 - tot.n0 / tot.n * ca.t) / (tot.n0 / tot.n * ca.t)
          + (ca.o1 - tot.n1 / tot.n * ca.t) * (ca.o1 - tot.n1 / tot.n * ca.t) / (tot.n1 / tot.n * ca.t)
    END AS chi2
  FROM cols c LEFT JOIN ca ON c.feature_id = ca.feature_id, tot
)"""


def with_(*fragments: str) -> str:
    return "WITH " + ",\n".join(f.strip() for f in fragments) + "\n"

# Document metadata: train (labelled, with label) and test (unlabelled).
DOCMETA = """
trm AS (SELECT d.doc_id AS ID, d.lang AS lang, d.source AS source, CAST(l.toxic AS INTEGER) AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tem AS (SELECT doc_id AS ID, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""

# Order metadata with nulls, and its filled form.
ORDMETA = """
om AS (SELECT o_orderkey AS ID, o_orderstatus,
              CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS o_orderpriority
       FROM orders),
omf AS (SELECT ID, coalesce(o_orderstatus, 'Missing') AS o_orderstatus,
               coalesce(o_orderpriority, 'Missing') AS o_orderpriority FROM om)"""

# Top-2 per column of train docs (lang, source): top2(column, value, n, rank).
DOC_TOP2 = """
trl AS (SELECT 'lang' AS "column", lang AS value FROM trm UNION ALL SELECT 'source', source FROM trm),
trc AS (SELECT "column", value, count(*) AS n FROM trl WHERE value IS NOT NULL GROUP BY 1, 2),
top2 AS (SELECT * FROM (SELECT "column", value, n,
           row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rank FROM trc) WHERE rank <= 2)"""

# Target statistics on train docs: ts(column, value, n, y_sum, y_mean, prior).
DOC_TARGET = """
tl AS (SELECT 'lang' AS "column", lang AS value, CAST(label AS DOUBLE) AS y FROM trm
       UNION ALL SELECT 'source', source, CAST(label AS DOUBLE) FROM trm),
pr AS (SELECT avg(CAST(label AS DOUBLE)) AS prior FROM trm),
ts AS (SELECT "column", value, count(*) AS n, sum(y) AS y_sum, avg(y) AS y_mean, pr.prior AS prior
       FROM tl, pr GROUP BY "column", value, pr.prior)"""

# Lineitem with a column-based score: li(l_orderkey, l_linenumber, p, y).
LINEITEM_SCORE = """
li AS (SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 AS DOUBLE) AS p,
              CAST(l_linestatus = 'O' AS INTEGER) AS y FROM lineitem)"""
