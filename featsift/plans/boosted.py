"""Queries over penalised boosting: trees and stopping rounds that SQL can retrace, and
the reference's chain with its penalties and a stop during training."""

from __future__ import annotations

from pyspark.sql import functions as F

from featsift.operators import boosting as B
from featsift.operators import split as SP
from featsift.operators.matrix import WideMatrix
from featsift.operators.models import XGB_PRESETS
from featsift.plans import oracle_sql as O
from featsift.plans.catalog import query, r6
from featsift.plans.closed_forms import _SHARES
from featsift.session import pin
from featsift.sources import tables as T

# ---------------------------------------------------------------- one penalised tree

_TREE = dict(learning_rate=0.3, max_depth=2, reg_lambda=2.0, reg_alpha=0.25, gamma=0.1, min_child_weight=1.5)


def _score(g: str, h: str, p: dict = _TREE) -> str:
    return f"pow(greatest(abs({g}) - {p['reg_alpha']}, 0), 2) / ({h} + {p['reg_lambda']})"


def _leaf(g: str, h: str, p: dict = _TREE) -> str:
    return f"(-{p['learning_rate']} * sign({g}) * greatest(abs({g}) - {p['reg_alpha']}, 0) / ({h} + {p['reg_lambda']}))"


def _level(d: int) -> str:
    """Sums, best split and next nodes of the rows of level ``d``; a row that stays has no next."""
    least = _TREE["min_child_weight"]
    return f"""
n{d} AS (SELECT node, sum(g) AS g, sum(h) AS h FROM at{d} GROUP BY node),
c{d} AS (SELECT a.node, e.feature_id, sum(a.g) AS g, sum(a.h) AS h FROM at{d} a JOIN entries e USING (row_id) GROUP BY ALL),
gain{d} AS (SELECT c.node, c.feature_id, round({_score('c.g', 'c.h')} + {_score('(n.g - c.g)', '(n.h - c.h)')} - {_score('n.g', 'n.h')}, 8) AS gain
            FROM c{d} c JOIN n{d} n USING (node) WHERE c.h >= {least} AND n.h - c.h >= {least}),
best{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature_id) AS k FROM gain{d})
            WHERE k = 1 AND gain > {B.LEAST_GAIN} AND gain >= {_TREE['gamma']}),
at{d + 1} AS (SELECT a.row_id, a.g, a.h, 2 * a.node + CAST(e.row_id IS NULL AS INTEGER) AS node
              FROM at{d} a JOIN best{d} b USING (node) LEFT JOIN entries e ON e.row_id = a.row_id AND e.feature_id = b.feature_id)"""


@query(
    "boost_penalised_tree",
    O.with_(O.TOKENS, "at0 AS (SELECT row_id, 0.5 - label AS g, CAST(0.25 AS DOUBLE) AS h, 1 AS node FROM rws)", _level(0), _level(1),
            "n2 AS (SELECT node, sum(g) AS g, sum(h) AS h FROM at2 GROUP BY node)",
            *(f"left{d} AS (SELECT a.row_id, a.node, {_leaf('n.g', 'n.h')} AS w FROM at{d} a JOIN n{d} n USING (node)"
              + (f" WHERE a.node NOT IN (SELECT node FROM best{d}))" if d < 2 else ")") for d in range(3)))
    + """SELECT row_id, CAST(node AS INTEGER) AS node, round(1 / (1 + exp(-w)), 6) AS p
FROM (SELECT * FROM left0 UNION ALL SELECT * FROM left1 UNION ALL SELECT * FROM left2)""",
)
def q_boost_penalised_tree(spark, sf):
    """L3/L4: one tree of depth 2 over every token with L1 and L2 leaf penalties, a split
    cost and a least child hessian; the leaf and probability of each labelled row."""
    m = T.token_matrix(spark, sf)
    model = B.fit(m, B.BoostParams(rounds=1, **_TREE))
    rows = B.binned_rows(m, model.features)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-B.weight_of(model.trees[0])))
    return rows.select("row_id", B.node_of(model.trees[0]).alias("node"), r6(p).alias("p"))


# ---------------------------------------------------------------- stopping

_STOP = dict(learning_rate=0.9, max_depth=1, reg_lambda=1.0, reg_alpha=0.1, min_child_weight=0.0)
_STOP_ROUNDS, _PATIENCE = 40, 2


def _split_sql() -> str:
    """The exact random hold-out of 30 % (as ``split_random``)."""
    return """
placed AS (SELECT row_id, label, row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rn FROM rws),
part AS (SELECT row_id, CASE WHEN rn <= ceil(0.3 * (SELECT count(*) FROM rws)) THEN 'valid' ELSE 'train' END AS part FROM placed)"""


@query(
    "boost_stop_curve",
    O.with_(O.TOKENS, _SHARES, _split_sql()).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", k AS (SELECT x, part, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS y FROM has JOIN part USING (row_id) GROUP BY ALL),
tr AS (SELECT sum(n) FILTER (x = 0) AS n0, sum(y) FILTER (x = 0) AS y0, sum(n) FILTER (x = 1) AS n1, sum(y) FILTER (x = 1) AS y1 FROM k WHERE part = 'train'),
run(round, m0, m1, loss, best, since) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE), 0
  UNION ALL
  SELECT round + 1, u0, u1, loss, least(best, loss), CASE WHEN loss < best THEN 0 ELSE since + 1 END
  FROM (SELECT *, (SELECT round(sum((n - y) * ln(1 + exp(CASE x WHEN 0 THEN u0 ELSE u1 END)) + y * ln(1 + exp(-CASE x WHEN 0 THEN u0 ELSE u1 END))) / sum(n), 12)
                   FROM k WHERE part = 'valid') AS loss
        FROM (SELECT round, best, since,
                     m0 + CASE WHEN gain > {B.LEAST_GAIN} THEN {_leaf('g0', 'h0', _STOP)} ELSE {_leaf('(g0 + g1)', '(h0 + h1)', _STOP)} END AS u0,
                     m1 + CASE WHEN gain > {B.LEAST_GAIN} THEN {_leaf('g1', 'h1', _STOP)} ELSE {_leaf('(g0 + g1)', '(h0 + h1)', _STOP)} END AS u1
              FROM (SELECT *, round({_score('g0', 'h0', _STOP)} + {_score('g1', 'h1', _STOP)} - {_score('(g0 + g1)', '(h0 + h1)', _STOP)}, 8) AS gain
                    FROM (SELECT run.*, n0 / (1 + exp(-m0)) - y0 AS g0, n1 / (1 + exp(-m1)) - y1 AS g1, n0 * exp(-m0) / pow(1 + exp(-m0), 2) AS h0, n1 * exp(-m1) / pow(1 + exp(-m1), 2) AS h1
                          FROM run, tr WHERE since < {_PATIENCE} AND round < {_STOP_ROUNDS}) AS a) AS b) AS c) AS d)
SELECT CAST(round AS INTEGER) AS round, round(loss, 6) AS loss, CAST(round - since AS INTEGER) AS best_round FROM run WHERE round > 0""",
)
def q_boost_stop_curve(spark, sf):
    """Stumps on one 0/1 column with a hold-out of 30 % and patience 2: the loss on
    the held-out rows after each round trained, and the best round so far."""
    m = T.token_matrix(spark, sf)
    n = m.rows.count()
    off = m.entries.groupBy("feature_id").agg(F.abs(F.lit(2) * F.count(F.lit(1)) - F.lit(n)).alias("off"))
    one = pin(off.orderBy("off", "feature_id").limit(1).select("feature_id"))
    column = WideMatrix(m.entries.join(F.broadcast(one), "feature_id"), m.rows)
    parts = pin(SP.split_random(m.rows.select("row_id"), 0.3, 42))
    model = B.fit(column, B.BoostParams(rounds=_STOP_ROUNDS, **_STOP), parts.where("split = 'test'").select("row_id"), patience=_PATIENCE)
    rows, best, at = [], float("inf"), 0
    for round_, part, loss in model.curve:
        if part == "valid":
            best, at = (loss, round_) if round(loss, 12) < round(best, 12) else (best, at)
            rows.append((round_, loss, at))
    return spark.createDataFrame(rows, "round int, loss double, best_round int").withColumn("loss", r6("loss"))


# ---------------------------------------------------------------- the chain

@query("boost_early_stop")
def q_boost_early_stop(spark, sf):
    """Every column, 15 % held out, boosted trees with the penalties of the
    reference's tall run, stopped by the held-out loss; every unlabelled row is scored.
    The learning rate (0.3) and patience (3) are ours: a round of depth 8 is nine Spark
    jobs, and the reference's 0.01 with patience 100 runs for hours at any size."""
    m = T.token_matrix(spark, sf)
    parts = pin(SP.split_random(m.rows.select("row_id"), 0.15, 42))
    p = B.BoostParams.preset(XGB_PRESETS["tall_3000"], learning_rate=0.3)
    model = B.fit(m, p, parts.where("split = 'test'").select("row_id"), patience=3)
    scored = B.predict(model, T.token_matrix(spark, sf, "unlabelled", with_columns=False))
    return scored.select("row_id", r6("p").alias("p"), "label_pred", F.lit(model.best_rounds).alias("best_rounds"), F.lit(len(model.trees)).alias("rounds"))
