"""Catalog queries against their DuckDB twins on sf0.001, and the driver contract."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SLOW = {"boost_early_stop", "gbt_early_stop", "gbt_eval_curve", "onehot_fused_score", "fused_score", "gbt_score"}
# Run with fewer rounds in test_chains.
SLOW |= {"reduced_gbt_submission", "metadata_gbt_score", "metadata_random_accuracy", "onehot_aligned_score"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        return ("f", repr(float(v)))  # strict: -0.0 differs from 0.0
    return ("s", str(v))


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_match(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    cols = sorted(sdf.columns)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    idx = [res.columns.index(c) for c in cols]
    b = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - SLOW))
def test_rows_only(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    assert rows and df.columns
    for r in rows:
        if "p" in df.columns:
            assert 0 <= r["p"] <= 1
            # p is rounded, the label is not taken from the rounded value
            assert abs(r["p"] - 0.5) < 1e-6 or r["label_pred"] == int(r["p"] > 0.5)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "label"]
    rows = df.collect()
    assert len(rows) == 113  # 200 documents, 87 labelled
    assert {r.label for r in rows} <= {0, 1}
