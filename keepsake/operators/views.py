"""Customer views and lookups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.metrics import count_if, mean, percent_of_count, sum_if
from keepsake.schema import SERVICE_FLAGS, Tables
from keepsake.storage import new_path

PROFILE = [
    "customer_id", "gender", "senior_citizen", "partner", "dependents",
    "tenure_months", "monthly_charges", "total_charges", "churn",
]


def with_contract(tables: Tables, how: str = "left") -> DataFrame:
    """Customers with their contract."""
    types = tables.contract_types.select("contract_type_id", "contract_name")
    return tables.customers.join(tables.customer_contracts, "customer_id", how).join(
        types, "contract_type_id", how
    )


def subscribed_counts(tables: Tables) -> DataFrame:
    """Subscribed rows per customer; combined before the shuffle."""
    return (
        tables.customer_services.filter("is_subscribed")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("subscribed_rows"))
    )


def with_subscribed_rows(df: DataFrame, tables: Tables) -> DataFrame:
    joined = df.join(subscribed_counts(tables), "customer_id", "left")
    return joined.withColumn("subscribed_rows", F.coalesce("subscribed_rows", F.lit(0).cast("long")))


def customer_full(tables: Tables) -> DataFrame:
    return with_subscribed_rows(with_contract(tables), tables).select(
        *PROFILE,
        F.col("contract_name").alias("contract_type"),
        "payment_method",
        "paperless_billing",
        F.col("subscribed_rows").alias("total_services"),
    )


def services_summary(tables: Tables) -> DataFrame:
    """One row per customer with a flag per service, in a single aggregation."""
    names = tables.service_types.select("service_type_id", "service_name")
    held = tables.customer_services.join(names, "service_type_id")
    return held.groupBy("customer_id").agg(
        *[
            F.expr(f"bool_or(CASE WHEN service_name = '{service}' THEN is_subscribed ELSE FALSE END) AS {flag}")
            for flag, service in SERVICE_FLAGS.items()
        ]
    )


def only_for(tables: Tables, chosen: DataFrame) -> Tables:
    """The tables cut down to a limited choice of customers.

    The choice is found once and written, so that the optimizer knows its size: where it is
    small, contracts and services are filtered while they are scanned, before any shuffle.
    """
    path = new_path(chosen.sparkSession, "chosen")
    chosen.write.parquet(path)
    chosen = chosen.sparkSession.read.schema(chosen.schema).parquet(path)
    ids = chosen.select("customer_id")
    return replace(
        tables,
        customers=chosen,
        customer_contracts=tables.customer_contracts.join(ids, "customer_id", "left_semi"),
        customer_services=tables.customer_services.join(ids, "customer_id", "left_semi"),
    )


def churn_summary(tables: Tables) -> DataFrame:
    return tables.customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_if(F.col("churn")).alias("churned_customers"),
        percent_of_count(count_if(F.col("churn")), F.count(F.lit(1))).alias("churn_rate_pct"),
        mean("monthly_charges").alias("avg_monthly_charges"),
        mean("tenure_months", 1).alias("avg_tenure_months"),
        sum_if(F.col("churn"), F.col("monthly_charges")).alias("monthly_revenue_at_risk"),
    )


def feature_base(tables: Tables, contract: bool = True, services: bool = True) -> DataFrame:
    """The profile, contract and service flags the features are built from.

    Without contract or services their columns are null or false and their tables unread.
    """
    flags = [F.coalesce(flag, F.lit(False)).alias(flag) for flag in SERVICE_FLAGS]
    if contract:
        base = with_contract(tables)
    else:
        base = tables.customers.withColumns(
            {c: F.lit(None).cast(kind) for c, kind in (("contract_name", "string"), ("payment_method", "string"), ("paperless_billing", "boolean"))}
        )
    if services:
        base = base.join(services_summary(tables), "customer_id", "left")
    else:
        base = base.withColumns({flag: F.lit(False) for flag in SERVICE_FLAGS})
    return (
        base
        .select(*PROFILE, F.col("contract_name").alias("contract_type"), "payment_method", "paperless_billing", *flags)
    )


def get_customers(tables: Tables, limit: int = 100, churn_only: bool = False) -> DataFrame:
    kept = tables.customers.filter("churn") if churn_only else tables.customers
    first = kept.orderBy("customer_id").limit(limit)
    return customer_full(only_for(tables, first)).orderBy("customer_id")


def customer_by_id(tables: Tables, customer_id: str) -> DataFrame:
    return feature_base(tables).filter(F.col("customer_id") == customer_id)


def page_profile(tables: Tables, customers: DataFrame) -> DataFrame:
    """The listed columns of the customers of a page."""
    return (
        with_contract(only_for(tables, customers))
        .select(*PROFILE, F.col("contract_name").alias("contract_type"), "payment_method")
        .orderBy("customer_id")
    )


def list_customers(tables: Tables, limit: int = 20, offset: int = 0) -> DataFrame:
    return page_profile(tables, tables.customers.orderBy("customer_id").offset(offset).limit(limit))


def at_risk_profile(tables: Tables, limit: int = 50) -> DataFrame:
    """Active month-to-month customers in their first year, dearest first."""
    top = (
        with_contract(replace(tables, customers=tables.customers.filter("NOT churn AND tenure_months <= 12")), "inner")
        .filter(F.col("contract_name") == "Month-to-month")
        .orderBy(F.col("monthly_charges").desc(), "customer_id")
        .limit(limit)
        .select(*PROFILE)
    )
    return feature_base(only_for(tables, top)).orderBy(F.col("monthly_charges").desc(), "customer_id")


def search_customers(tables: Tables, term: str, limit: int = 20) -> DataFrame:
    """Case-insensitive match anywhere in the id; % and _ in the term are wildcards."""
    hits = tables.customers.filter(F.col("customer_id").ilike(f"%{term}%")).orderBy("customer_id").limit(limit)
    return hit_profile(tables, hits)


def hit_profile(tables: Tables, hits: DataFrame) -> DataFrame:
    """The columns of a search result."""
    return (
        with_contract(only_for(tables, hits))
        .select(
            "customer_id", "gender", "senior_citizen", "tenure_months", "monthly_charges", "churn",
            F.col("contract_name").alias("contract_type"),
        )
        .orderBy("customer_id")
    )
