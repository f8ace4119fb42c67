"""Plan-shape regression tests: the scale properties the design relies on."""

import pytest

from featsift.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chi2_score", "target_encode", "top_categories", "split_disjoint", "matrix_shape",
                                  "standardize", "gather_selected", "topk_anova"])
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_top_categories_limits_before_shuffle(spark):
    plan = _plan(QUERIES["top_categories"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_chi2_single_scan_single_aggregate(spark):
    plan = _plan(QUERIES["chi2_score"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 2  # documents once, labels once
    assert "SortMergeJoin" not in plan  # no spine join
    assert plan.count("Exchange hashpartitioning") == 1  # the one groupBy(feature_id)


def test_gather_broadcasts_bounded_selection(spark):
    plan = _plan(QUERIES["gather_selected"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scans_prune_columns(spark):
    plan = _plan(QUERIES["metric_logloss"](spark, SF_SMALL))
    read = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "l_discount" in read and "l_linestatus" in read and "l_comment" not in read and "l_quantity" not in read
