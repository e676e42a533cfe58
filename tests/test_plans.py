"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from keepsake.functions import ranking
from keepsake.operators import analytics, views
from keepsake.plans import registry
from keepsake.plans.registry import all_queries as queries
from keepsake.sources import sinks
from keepsake.sources.star_schema import retention_tables

SF = "/root/testdata/sf0.01"
PYTHON_FREE = [
    n for n in queries() if n[0] in "svlqwfd" or n in ("p01_score", "p03_linear_attribution", "p05_top_reasons")
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when only the lookups and chosen rows are small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in PYTHON_FREE if n[0] in "vlqd" or n.startswith(("p0", "f09", "s0"))])
def test_no_python_and_no_nested_loops(spark, no_broadcast, name):
    text = plan(queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text



@pytest.mark.parametrize("name", ["q09_clv_quartiles", "q10_rfm_segments", "q16_loyal_low_spenders", "w1_global_ntile",
                                  "w2_global_rank", "w3_first_rank_quartile", "f08_select_features", "m01_split"])
def test_rankings_never_sort_in_one_task(spark, name):
    df = queries()[name](spark, SF)
    text = plan(df)
    for place in re.finditer("Exchange SinglePartition", text):
        # only the per-partition totals (one row each) may meet in one task
        assert "_part" in text[max(0, place.start() - 600) : place.start() + 600]


def test_tiles_need_no_shuffle_of_the_rows(spark):
    customers = retention_tables(spark, SF).customers
    tiled = ranking.add_ntiles(customers, 5, {"r": F.col("tenure_months")}, "customer_id")
    assert "Exchange" not in plan(tiled)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    sinks.load_tables(retention_tables(spark, SF), str(tmp_path))
    stored = sinks.stored_tables(spark, str(tmp_path))
    text = views.customer_by_id(stored, "Customer#000000042")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line and "customer_id" in line]
    assert len(scans) == 3
    assert all("EqualTo(customer_id,Customer#000000042)" in line for line in scans)
    text = plan(analytics.churn_by_tenure(stored))
    assert "ReadSchema: struct<tenure_months:int,monthly_charges:decimal(10,2),churn:boolean>" in text


def test_limited_lookups_filter_before_the_shuffle(spark, no_broadcast):
    text = plan(views.at_risk_profile(retention_tables(spark, SF), 50))
    assert "LeftSemi" in text and "BroadcastHashJoin" in text
    assert text.count("FileScan") == 5  # the choice is not searched again


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS keepsake_test LOCATION '{tmp_path}'")
    sinks.load_bucketed(retention_tables(spark, SF), "keepsake_test", 8)
    stored = sinks.bucketed_tables(spark, "keepsake_test")
    df = views.feature_base(stored)
    assert "Exchange hashpartitioning" not in plan(df)
    assert df.exceptAll(views.feature_base(retention_tables(spark, SF))).count() == 0
    for name in sinks.TABLES:
        spark.sql(f"DROP TABLE keepsake_test.{name}")
    spark.sql("DROP DATABASE keepsake_test")


def test_single_scan_reports(spark):
    tables = retention_tables(spark, SF)
    assert plan(analytics.revenue_impact(tables)).count("FileScan") == 1
    assert plan(analytics.executive_kpis(tables)).count("FileScan") == 2


def test_feature_groups_read_only_what_they_need(spark):
    text = plan(queries()["f01_demographics"](spark, SF))
    assert text.count("FileScan") == 1 and "Exchange" not in text
    for name in ("f02_services", "f03_contract"):
        assert plan(queries()[name](spark, SF)).count("FileScan") == 2


def test_rules_read_each_table_once(spark):
    assert plan(queries()["s13_check_rules"](spark, SF)).count("FileScan") == 4


def test_adoption_keeps_one_row_a_customer_in_memory(spark):
    plan = analytics.service_adoption(retention_tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"keys=\[([^\]]*)\]", plan)
    assert any("customer_id" in k for k in keys) and not any("customer_id" in k and "service_type_id" in k for k in keys)


def test_streamed_customers_are_dealt_to_all_cores(spark):
    plan = registry._customer_stream(spark, "/root/testdata/sf0.001")._jdf.queryExecution().logical().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan
