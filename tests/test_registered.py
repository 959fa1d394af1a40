"""Every registered query against its SQL on the smallest data set."""

import pytest

from tests.oracle import compare, connect
from wardflow.plans import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_returns_rows(spark, name):
    """Only fitted models have no SQL form."""
    assert queries()[name].__module__ and name in {
        "no_show_logistic_scores", "no_show_calibrated_metrics", "no_show_boosted_metrics", "no_show_feature_importance",
        "demand_poisson_metrics", "duration_boosted_metrics", "candidate_scores",
    }
    assert not queries()[name](spark, FOLDER).isEmpty()


def test_entry_and_registry_agree(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
