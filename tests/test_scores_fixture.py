import math

import pytest
from pyspark.sql import functions as F

from featsift.operators import matrix as MX
from featsift.operators import scores as SC
from featsift.operators import select as SE
from featsift.operators import stats as ST


def _d(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def test_anova_f_contract(f6):
    f = _d(SC.anova_f(f6), "feature_id", "f_score")
    assert f[0] == pytest.approx(4.5)
    assert f[4] == pytest.approx(4.5)
    assert f[1] is None  # constant non-zero
    assert f[2] is None  # all zero
    assert f[3] == math.inf  # perfect separator
    assert f[5] == pytest.approx(0.0, abs=1e-12)


def test_chi2_contract(f6):
    c = _d(SC.chi2_score(f6), "feature_id", "chi2")
    assert c[0] == pytest.approx(1.8)
    assert c[1] == pytest.approx(0.0, abs=1e-12)
    assert c[2] is None
    assert c[3] == pytest.approx(3.0)
    assert c[4] == pytest.approx(1.8)


def test_topk_f_perfect_first_ties_by_id(f6):
    sel = SE.select_top_k(SC.anova_f(f6), 2, "f_score")
    assert [r.feature_id for r in sel.orderBy("rank").collect()] == [3, 0]


def test_topk_chi2_without_negative_feature(f6):
    m = MX.drop_features(f6, f6.columns.where(F.col("feature_id") == 5))
    sel = SE.select_top_k(SC.chi2_score(m), 2, "chi2")
    assert [r.feature_id for r in sel.orderBy("rank").collect()] == [3, 0]


def test_non_negative_guard(f6):
    with pytest.raises(ValueError):
        ST.assert_non_negative(f6)
    neg = _d(ST.negative_columns(f6), "feature_id", "has_negative")
    assert neg == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}
    assert ST.negative_column_count(f6).first()[0] == 1


def test_moments_implicit_zeros(f6):
    mo = {r.feature_id: r for r in ST.column_moments(f6).collect()}
    # feature 0: values 1,2,1,0,1,0 -> mean 5/6, var_pop = 7/6 - 25/36
    assert mo[0].mean == pytest.approx(5 / 6)
    assert mo[0].var == pytest.approx(7 / 6 - 25 / 36)
    assert mo[1].std == 0.0 and mo[2].std == 0.0
    assert mo[5].min == -1.0 and mo[5].max == 2.0
    const = _d(ST.constant_by_value(f6), "feature_id", "is_constant")
    assert const == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False}
    cc = ST.constant_count(f6).first()
    assert (cc.n_constant, cc.n_columns) == (2, 6)


def test_pvalues_match_closed_forms(f6):
    p = {r.feature_id: r for r in SC.anova_pvalue(f6).collect()}
    assert p[3].p_value == 0.0
    assert p[1].p_value is None or math.isnan(p[1].p_value)
    # F(1, 4) at 4.5: two-sided t test with 4 dof at t = sqrt(4.5)
    assert p[0].p_value == pytest.approx(0.10119, abs=1e-4)
    c = {r.feature_id: r for r in SC.chi2_pvalue_table(f6).collect()}
    assert c[3].p_value == pytest.approx(math.erfc(math.sqrt(3.0 / 2)))


def test_row_without_selected_entries_survives(f6):
    # Row 3 only has feature 1; dropping feature 1 must keep it as an all-zero vector.
    kept = SE.nonconstant_selection(ST.nonconstant_features(f6, 0.0))
    g = MX.gather(f6, kept, bound_rows=10)
    width = kept.count()
    vec = {r.row_id: r.features.toArray().tolist() for r in MX.to_vectors(g, width).collect()}
    assert len(vec) == 6
    assert vec[3] == [0.0] * width
    sparse = {r.row_id: r.features for r in MX.to_vectors(g, width, sparse=True).collect()}
    assert sparse[3].numNonzeros() == 0
    assert sparse[0].toArray().tolist() == vec[0]


def test_k_larger_than_columns(f6):
    f = SC.anova_f(f6)
    for k in (10, 5000):  # small path and distributed path
        sel = SE.select_top_k(f, k, "f_score")
        got = [r.feature_id for r in sel.orderBy("rank").collect()]
        assert got[:2] == [3, 0] and len(got) == 6
        assert sorted(r.new_index for r in sel.collect()) == list(range(6))


def test_anova_needs_two_classes(spark, f6):
    one = MX.WideMatrix(entries=f6.entries, rows=f6.rows.withColumn("label", F.lit(1)))
    with pytest.raises(ValueError):
        SC.anova_f(one)
