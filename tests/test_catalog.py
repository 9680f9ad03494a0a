"""Contract: entry runs, every query runs on the smallest tables, plans avoid known hazards."""

import pytest

import __spark_entry__ as E
from quarry import catalog
from tests.conftest import SF

OWN = {n: f for n, f in catalog.queries().items()}  # the training-data queries have their own tests


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 8 and "median" in df.columns


# trained or sampled beyond what SQL can follow; tested in test_round3.py and test_network.py
NO_ORACLE = {"clf_predictions", "reg_predictions", "ml_feature_importance_values", "ml_record_scores", "clf_knn_indexed", "reg_knn_indexed",
             "clf_mlp_probabilities", "clf_svm_probabilities"}


def test_every_query_has_an_oracle():
    assert set(OWN) - NO_ORACLE == set(catalog.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries()) and set(OWN) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_runs_at_smallest_scale(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_info_scans_once_and_no_cartesian(spark):
    from quarry.operators.profile import column_info
    from quarry.session import table
    plan = _plan(column_info(table(spark, SF, "lineitem")))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_a_partial_group_limit(spark):
    from quarry.operators.profile import categorical_profile
    from quarry.session import table
    df = categorical_profile(table(spark, SF, "customer"))
    df.collect()
    assert "WindowGroupLimit" in _plan(df)
