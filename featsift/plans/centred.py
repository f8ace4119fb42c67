"""Queries over standardised sparse matrices; their SQL lists every cell, zeros too."""

from __future__ import annotations

from pyspark.sql import functions as F

from featsift.operators import shifted as SH
from featsift.operators import stats as ST
from featsift.plans import oracle_sql as O
from featsift.plans.catalog import query
from featsift.session import pin
from featsift.sources import tables as T

_EVERY = """
own AS (SELECT DISTINCT feature_id FROM entries),
mom AS (SELECT feature_id, sum(value) / (SELECT count(*) FROM rws) AS mean,
               sqrt(sum(value * value) / (SELECT count(*) FROM rws) - pow(sum(value) / (SELECT count(*) FROM rws), 2)) AS std
        FROM entries GROUP BY feature_id),
every AS (SELECT r.row_id, r.label, o.feature_id, (coalesce(e.value, 0) - m.mean) / CASE WHEN m.std < 1e-12 THEN 1 ELSE m.std END AS z
          FROM rws r CROSS JOIN own o JOIN mom m USING (feature_id) LEFT JOIN entries e ON e.row_id = r.row_id AND e.feature_id = o.feature_id)"""


def _standardised(spark, sf):
    m = T.token_matrix(spark, sf, with_columns=False)
    fit = pin(ST.column_moments(m).select("feature_id", "mean", F.when(F.col("std") < 1e-12, 0.0).otherwise(F.col("std")).alias("std")))
    return m, SH.standardize(m, fit)


@query(
    "standardize_rows",
    O.with_(O.TOKENS, _EVERY)
    + "SELECT row_id, round(sum(z * z), 3) AS energy, round(sum(z) / sqrt(count(*)), 6) + 0.0 AS total FROM every GROUP BY row_id",
)
def q_standardize_rows(spark, sf):
    """E5 with implicit zeros: squared length and (scaled) sum of each labelled row of the
    standardised token matrix, over all columns."""
    _, x = _standardised(spark, sf)
    width = x.shift.count()
    ones = x.shift.select("feature_id", F.lit(1.0 / width**0.5).alias("weight"))
    return SH.row_energy(x).select("row_id", F.round("energy", 3).alias("energy")).join(
        SH.row_products(x, ones).select("row_id", F.round("product", 6).alias("total")), "row_id"
    )


@query(
    "standardize_class_means",
    O.with_(O.TOKENS, _EVERY)
    + "SELECT feature_id, round(avg(z), 6) + 0.0 AS mean, round(avg(z * z), 6) AS squares FROM every WHERE label = 1 GROUP BY feature_id",
)
def q_standardize_class_means(spark, sf):
    """E5 with implicit zeros: mean and mean square of each standardised token column over
    the rows of class 1."""
    m, x = _standardised(spark, sf)
    rows = m.rows.where("label = 1")
    n = rows.count()
    sums = SH.column_sums(x, rows)
    return sums.select("feature_id", (F.round(F.col("total") / n, 6) + 0.0).alias("mean"), F.round(F.col("squares") / n, 6).alias("squares"))
