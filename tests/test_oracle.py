"""Every query with a SQL counterpart holds the same rows; the others run."""

import pytest

import __spark_entry__ as entry
from cartlens.plans.oracle import ORACLES
from cartlens.plans.registry import registered
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()
PLANNED_WITHOUT_SQL = {
    "homepage_recommendations",
    "offer_recommendations",
    "offer_strengths",
    "repurchase_forest_depths",
    "repurchase_full_predictions",
    "repurchase_model_metrics",
    "repurchase_predictions",
    "silhouette_sweep",
    "svd_cell_rmse",
    "svd_factors",
    "svd_recommendations",
    "training_report",
    "user_segments",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, SQL[name]) is None


def test_every_query_is_accounted_for():
    assert set(registered()) == set(ORACLES) | PLANNED_WITHOUT_SQL
    # Whatever else is registered has its own tests; its SQL belongs to a query.
    assert set(registered()) <= set(entry.queries()) and set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
