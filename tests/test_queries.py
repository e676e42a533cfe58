"""Every registered query against its SQL statement, on the smallest given tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

from __spark_entry__ import entry
from keepsake.plans import oracle, registry

SF = "/root/testdata/sf0.001"
QUERIES, STATEMENTS = registry.all_queries(), oracle.statements()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_only_known_queries_go_without_sql():
    without = set(QUERIES) - set(STATEMENTS)
    assert without == {
        "m05_logistic_regression", "m06_random_forest", "m07_boosted_trees",
        "m06b_histogram_forest", "m07b_second_order_boosting", "m08_cross_validation",
        "m14_run_log", "p04_tree_attribution", "p04b_tree_reasons",
    }
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, STATEMENTS[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 4
