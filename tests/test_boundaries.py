"""Hand-made rows: edges of every band, missing contracts, refused services, empty tables."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keepsake import schema
from keepsake.functions import bands
from keepsake.operators import analytics, features, reports, scoring, views
from keepsake.plans.fixed_model import fixed_model
from keepsake.schema import Tables
from keepsake.sources import quality, raw
from keepsake.sources.star_schema import retention_tables

CUSTOMER = (
    "customer_id string, gender string, senior_citizen boolean, partner boolean, dependents boolean,"
    " tenure_months int, monthly_charges decimal(10,2), total_charges decimal(10,2), churn boolean"
)
CONTRACT = "customer_id string, contract_type_id int, payment_method string, paperless_billing boolean"
SERVICE = "customer_id string, service_type_id int, is_subscribed boolean"


def tables(spark, customers, contracts=(), services=()) -> Tables:
    rows = [
        (c[0], "Male", False, False, False, c[1], Decimal(c[2]), None if c[3] is None else Decimal(c[3]), c[4])
        for c in customers
    ]
    return Tables(
        spark.createDataFrame(rows, CUSTOMER),
        spark.createDataFrame(list(contracts), CONTRACT),
        spark.createDataFrame(list(services), SERVICE),
        schema.contract_types(spark),
        schema.service_types(spark),
    )


def values(spark, function, inputs, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_risk_levels_at_their_edges(spark):
    p = [0.0, 0.2499, 0.25, 0.4, 0.5, 0.7, 0.75, 1.0]
    assert values(spark, bands.model_risk_level, p) == [
        "Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical",
    ]
    assert values(spark, bands.table_risk_level, p) == [
        "low", "low", "low", "medium", "medium", "high", "high", "high",
    ]
    assert values(spark, bands.report_bin, p) == [
        None, "Low (0-25%)", "Low (0-25%)", "Medium (25-50%)", "Medium (25-50%)", "High (50-75%)",
        "High (50-75%)", "Critical (75-100%)",
    ]


def test_tenure_and_charge_edges(spark):
    t = [0, 6, 7, 12, 13, 24, 25, 48, 49, 73]
    assert values(spark, lambda v: bands.up_to(v, bands.TENURE_BUCKETS, labels=False), t, "int") == [
        1, 1, 2, 2, 3, 3, 4, 4, 5, 5,
    ]
    t = [0, 11, 12, 23, 24, 35, 36, 47, 48, 59, 60, 72]
    assert values(spark, lambda v: bands.at_least(v, bands.TENURE_COHORTS, labels=False), t, "int") == [
        6, 6, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1,
    ]
    m = [29.99, 30, 49.99, 50, 69.99, 70, 89.99, 90]
    got = values(spark, lambda v: bands.up_to(v, bands.CHARGE_BANDS, labels=False, inclusive=False), [float(x) for x in m])
    assert got == [1, 2, 2, 3, 3, 4, 4, 5]


def test_segments_at_their_edges(spark):
    customers = [
        ("a", 6, "70.01", "1", False), ("b", 6, "70.00", "1", False), ("c", 12, "90", "1", True),
        ("d", 13, "90", "1", False), ("e", 12, "90", "1", False), ("f", 13, "90", "1", False),
    ]
    contracts = [(c, 1 if c in "abcd" else 2, "Mailed check", True) for c in "abcdef"]
    got = analytics.risk_segments(tables(spark, customers, contracts)).collect()
    assert [(r["risk_segment"], r["customer_count"]) for r in got] == [
        ("Critical Risk", 1), ("High Risk", 2), ("Medium Risk", 2), ("Low Risk", 1),
    ]


def test_customers_without_contract_or_service(spark):
    t = tables(
        spark,
        [("a", 5, "80", None, False), ("b", 5, "80", "10", True)],
        [("b", 1, "Electronic check", True)],
        [("b", 9, False), ("b", 1, True)],
    )
    full = {r["customer_id"]: r for r in views.customer_full(t).collect()}
    assert full["a"]["contract_type"] is None and full["a"]["total_services"] == 0
    assert full["b"]["total_services"] == 1
    base = {r["customer_id"]: r for r in views.feature_base(t).collect()}
    assert base["a"]["has_phone_service"] is False and base["b"]["has_phone_service"] is True
    assert base["b"]["has_tech_support"] is False
    kpis = {r["metric"]: r["value"] for r in analytics.executive_kpis(t).collect()}
    assert kpis["Total Customers"] == "2" and kpis["Month-to-Month Customers"] == "1"
    assert kpis["Churn Rate (%)"] == "50.00"
    adoption = {r["service_name"]: r for r in analytics.service_adoption(t).collect()}
    assert len(adoption) == 11
    assert adoption["PhoneService"]["customers_with_service"] == 1
    assert adoption["PhoneService"]["customers_without_service"] == 1
    assert adoption["TechSupport"]["customers_without_service"] == 2
    assert adoption["TechSupport"]["churn_rate_with_service"] is None
    bundles = {r["service_bundle"]: r["customers"] for r in analytics.service_bundles(t).collect()}
    assert bundles == {None: 1, "PhoneService": 1}


def test_unknown_contract_and_null_total_in_both_modes(spark):
    t = tables(spark, [("a", 5, "80", None, False), ("b", 9, "20", "10", True)], [("b", 9, "Voucher", None)])
    base = views.feature_base(t)
    frame = {r["customer_id"]: r for r in features.training_frame(base).collect()}
    for row in frame.values():
        assert row["contract_length"] == 0 and row["has_long_contract"] == 0 and row["has_auto_payment"] == 0
    assert frame["a"]["avg_monthly_spend"] == 0.0 and frame["a"]["spending_trend"] == 0
    assert frame["a"]["estimated_clv"] == 0.0
    requests = features.profile_to_request(base)
    assert quality.valid_requests(requests).count() == 0  # neither names a contract
    assert scoring.score_requests(requests, fixed_model()).count() == 0


def test_empty_tables(spark):
    t = tables(spark, [])
    assert views.churn_summary(t).first()["churn_rate_pct"] is None
    assert analytics.clv_quartiles(t).count() == 0
    assert analytics.rfm_segments(t).count() == 0
    assert analytics.revenue_impact(t).count() == 4
    scored = scoring.scored_customers(t, fixed_model())
    assert [r["n"] for r in reports.risk_distribution(scored).collect()] == [0, 0, 0, 0]
    assert reports.risk_list_stats(scored).first()["avg_probability"] == 0.0
    assert {r["n"] for r in scoring.batch_summary(scored).collect()} == {0}


def test_rules_find_violations(spark):
    t = tables(
        spark,
        [("a", -1, "80", "1", False), ("a", 80, "-2", "-1", False)],
        [("x", 9, "Mailed check", True)],
        [("a", 1, True), ("a", 1, False), ("a", 77, True)],
    )
    found = {(r["table_name"], r["rule"]): r["violations"] for r in quality.check_rules(t).collect()}
    assert found["customers", "tenure_not_negative"] == 1
    assert found["customers", "tenure_at_most_72"] == 1
    assert found["customers", "monthly_not_negative"] == 1
    assert found["customers", "total_not_negative"] == 1
    assert found["customers", "unique_customer_id"] == 1
    assert found["customer_services", "unique_customer_id_service_type_id"] == 1
    assert found["customer_contracts", "known_customer_id"] == 1
    assert found["customer_contracts", "known_contract_type_id"] == 1
    assert found["customer_services", "known_service_type_id"] == 1
    many = spark.range(101).select(F.col("id").alias("customer_id"))
    assert quality.check_batch_size(many).first()["violated"] is True
    assert quality.check_batch_size(many.limit(100)).first()["violated"] is False


RAW_ROW = dict(
    customerID="a", gender="Female", SeniorCitizen=1, Partner="Yes", Dependents="No", tenure=2, PhoneService="No",
    MultipleLines="No phone service", InternetService="DSL", OnlineSecurity="Yes", OnlineBackup="No",
    DeviceProtection="No", TechSupport="No", StreamingTV="No", StreamingMovies="Yes", Contract="One year",
    PaperlessBilling="No", PaymentMethod="Mailed check", MonthlyCharges=20.25, TotalCharges=" ", Churn="No",
)


def raw_rows(spark, *changes):
    rows = [tuple({**RAW_ROW, **c}[f.name] for f in schema.RAW_SCHEMA) for c in changes]
    return spark.createDataFrame(rows, schema.RAW_SCHEMA)


@pytest.mark.parametrize(
    "change,ids",
    [
        ({}, [3, 6, 11]),
        ({"PhoneService": "Yes", "MultipleLines": "Yes"}, [1, 2, 3, 6, 11]),
        ({"PhoneService": "No", "MultipleLines": "Yes"}, [3, 6, 11]),
        ({"InternetService": "No", "OnlineSecurity": "Yes"}, [5]),
        ({"InternetService": "Cable"}, [5, 6, 11]),
        ({"InternetService": "Fiber optic"}, [4, 6, 11]),
    ],
)
def test_service_rows(spark, change, ids):
    got = raw.to_services(raw.clean(raw_rows(spark, change)))
    assert sorted(r["service_type_id"] for r in got.collect()) == ids


def test_cleaning(spark):
    got = raw.clean(
        raw_rows(spark, {}, {"TotalCharges": "12.5", "Partner": "maybe"}, {"tenure": None, "TotalCharges": "x"})
    ).collect()
    assert [r["totalcharges"] for r in got] == [40.5, 12.5, 0.0]
    assert [r["partner"] for r in got] == [True, None, True]
    assert got[0]["seniorcitizen"] is True
    t = raw.ingest(raw_rows(spark, {"Contract": "Weekly"}, {"Churn": "Yes"}), "2024-03-01")
    contracts = t.customer_contracts.collect()
    assert sorted(str(r["contract_type_id"]) for r in contracts) == ["2", "None"]
    assert {str(r["contract_start_date"]) for r in contracts} == {"2024-01-01"}
    days = [r["churn_date"] for r in t.customers.collect()]
    assert None in days and sum(d is not None for d in days) == 1


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 5.0, 10.0, 130.0, 200.0, None)], "v double")
    got = {r["bin"]: r["n"] for r in reports.histogram(df, F.col("v"), 0.0, 10.0, 2).collect()}
    assert got == {-1: 1, 0: 1, 1: 2, 2: 2, None: 1}


def test_services_beyond_the_fixed_ones_are_reported(spark):
    from dataclasses import replace

    tables = retention_tables(spark, "/root/testdata/sf0.001")
    added = tables.service_types.limit(1).withColumns({"service_type_id": F.lit(70), "service_name": F.lit("NewService")})
    held = tables.customers.limit(3).select("customer_id", F.lit(70).alias("service_type_id"), F.lit(True).alias("is_subscribed"))
    more = replace(
        tables, service_types=tables.service_types.unionByName(added),
        customer_services=tables.customer_services.unionByName(held),
    )
    rows = {r["service_name"]: r for r in analytics.service_adoption(more).collect()}
    assert len(rows) == 12 and rows["NewService"]["customers_with_service"] == 3
    assert rows["NewService"]["customers_without_service"] == tables.customers.count() - 3


def test_scored_and_rejected_requests_are_all_requests(spark):
    tables = retention_tables(spark, "/root/testdata/sf0.001")
    requests = features.profile_to_request(views.feature_base(tables))
    rejected = quality.rejected_requests(requests)
    assert 0 < rejected.count() < requests.count()
    assert quality.valid_requests(requests).count() + rejected.count() == requests.count()
    assert rejected.filter("size(broken_rules) = 0").count() == 0
