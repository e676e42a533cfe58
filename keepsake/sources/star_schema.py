"""Retention tables derived from the given star-schema `customer` table.

The formulas use integer arithmetic and CASE only, so the same text holds in Spark
SQL and in other SQL engines; the correctness queries reuse it word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake import schema
from keepsake.schema import Tables

AS_OF = "2024-01-01"

# How a given customer row becomes retention attributes.
TENURE = "CAST((c_custkey * 37 + c_nationkey * 11) % 73 AS INT)"
CHARGE_CENTS = "(1825 + (CAST(ROUND(c_acctbal * 100) AS BIGINT) + 100000) % 10051)"
TOTAL_CENTS = f"({CHARGE_CENTS} * {TENURE} + (c_custkey * 53) % 2000)"
CONTRACT_ID = (
    "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 1"
    " WHEN c_mktsegment = 'HOUSEHOLD' THEN 2 ELSE 3 END"
)
CONTRACT_NAME = (
    "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'Month-to-month'"
    " WHEN c_mktsegment = 'HOUSEHOLD' THEN 'One year' ELSE 'Two year' END"
)
PAYMENT = (
    "CASE c_nationkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'"
    " WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END"
)
SENIOR = "(c_custkey * 31) % 100 < 16"
PARTNER = "(c_custkey * 17) % 100 < 48"
DEPENDENTS = "(c_custkey * 13) % 100 < 30"
PAPERLESS = "c_nationkey % 5 < 3"
CHURN = (
    f"((CASE WHEN ({CONTRACT_ID}) = 1 THEN 3 ELSE 0 END) + (CASE WHEN {TENURE} <= 12 THEN 2 ELSE 0 END)"
    " + (CASE WHEN c_nationkey % 4 = 0 THEN 2 ELSE 0 END) + (c_custkey * 7) % 5) >= 7"
)
PHONE = "(c_custkey * 19) % 10 < 9"
LINES = f"({PHONE} AND (c_custkey * 7) % 5 < 2)"
INTERNET = (
    "CASE WHEN (c_custkey * 23) % 100 < 34 THEN 'DSL'"
    " WHEN (c_custkey * 23) % 100 < 78 THEN 'Fiber optic' ELSE 'No' END"
)


def _money(cents: str) -> str:
    return (
        f"CAST(CAST({cents} AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2))"
    )


def _add_on(service_id: int) -> str:
    """Spread of an add-on over customers: below 4 subscribed, 4-5 an explicit refusal, else no row."""
    return f"((c_custkey * {2 * service_id + 1} + {service_id}) % 10)"


def _yes_no(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'Yes' ELSE 'No' END"


def _raw_add_on(service_id: int) -> str:
    return (
        f"CASE WHEN ({INTERNET}) = 'No' THEN 'No internet service'"
        f" WHEN {_add_on(service_id)} < 4 THEN 'Yes' ELSE 'No' END"
    )


CUSTOMERS = {
    "customer_id": "c_name",
    "gender": "CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END",
    "senior_citizen": SENIOR,
    "partner": PARTNER,
    "dependents": DEPENDENTS,
    "tenure_months": TENURE,
    "monthly_charges": _money(CHARGE_CENTS),
    "total_charges": f"CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE {_money(TOTAL_CENTS)} END",
    "churn": CHURN,
}
# Some customers have no contract, some no services; some rows belong to customers that are gone.
CONTRACT_PRESENT = "c_custkey % 43 <> 5"
CONTRACTS = {
    "customer_id": "CASE WHEN c_custkey % 101 = 7 THEN 'Former ' || c_name ELSE c_name END",
    "contract_type_id": CONTRACT_ID,
    "payment_method": PAYMENT,
    "paperless_billing": PAPERLESS,
}
RAW = {
    "customerID": "c_name",
    "gender": CUSTOMERS["gender"],
    "SeniorCitizen": f"CASE WHEN {SENIOR} THEN 1 ELSE 0 END",
    "Partner": _yes_no(PARTNER),
    "Dependents": _yes_no(DEPENDENTS),
    "tenure": TENURE,
    "PhoneService": _yes_no(PHONE),
    "MultipleLines": f"CASE WHEN NOT ({PHONE}) THEN 'No phone service' WHEN {LINES} THEN 'Yes' ELSE 'No' END",
    "InternetService": INTERNET,
    "OnlineSecurity": _raw_add_on(6),
    "OnlineBackup": _raw_add_on(7),
    "DeviceProtection": _raw_add_on(8),
    "TechSupport": _raw_add_on(9),
    "StreamingTV": _raw_add_on(10),
    "StreamingMovies": _raw_add_on(11),
    "Contract": CONTRACT_NAME,
    "PaperlessBilling": _yes_no(PAPERLESS),
    "PaymentMethod": PAYMENT,
    "MonthlyCharges": f"CAST({_money(CHARGE_CENTS)} AS DOUBLE)",
    "TotalCharges": f"CASE WHEN c_custkey % 97 = 0 THEN ' ' ELSE CAST({_money(TOTAL_CENTS)} AS VARCHAR(20)) END",
    "Churn": _yes_no(CHURN),
}
# One candidate row per (customer, service id): is the row there, and is it subscribed?
SERVICE_PRESENT = (
    f"CASE service_type_id WHEN 1 THEN {PHONE} WHEN 2 THEN {LINES}"
    f" WHEN 3 THEN ({INTERNET}) = 'DSL' WHEN 4 THEN ({INTERNET}) = 'Fiber optic'"
    f" WHEN 5 THEN ({INTERNET}) = 'No'"
    f" ELSE ({INTERNET}) <> 'No' AND (c_custkey * (2 * service_type_id + 1) + service_type_id) % 10 < 6 END"
)
SERVICE_SUBSCRIBED = (
    "service_type_id <= 5 OR (c_custkey * (2 * service_type_id + 1) + service_type_id) % 10 < 4"
)


SERVICE_OWNER = "CASE WHEN c_custkey % 89 = 11 THEN 'Former ' || c_name ELSE c_name END"
# Row numbers 1 to 11 are the services; row 12 repeats service 6 for some customers.
SERVICE_ID = "CASE WHEN service_row = 12 THEN 6 ELSE service_row END"
SERVICE_GIVEN = "c_custkey % 47 <> 3 AND (service_row <= 11 OR c_custkey % 59 = 4)"


def select_list(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in columns.items()]


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def retention_tables(spark: SparkSession, sf_dir: str) -> Tables:
    given = _given(spark, sf_dir)
    # Service rows come from exploding a fixed list inside each customer row: no join, no shuffle.
    rows = F.sequence(F.lit(1), F.lit(len(schema.SERVICE_TYPES) + 1))
    services = (
        given.select("c_custkey", "c_name", F.explode(rows).alias("service_row"), "c_nationkey")
        .filter(SERVICE_GIVEN)
        .selectExpr("*", f"{SERVICE_ID} AS service_type_id")
        .filter(SERVICE_PRESENT)
        .selectExpr(f"{SERVICE_OWNER} AS customer_id", "service_type_id", f"{SERVICE_SUBSCRIBED} AS is_subscribed")
    )
    return Tables(
        customers=given.selectExpr(*select_list(CUSTOMERS)),
        customer_contracts=given.filter(CONTRACT_PRESENT).selectExpr(*select_list(CONTRACTS)),
        customer_services=services,
        contract_types=schema.contract_types(spark),
        service_types=schema.service_types(spark),
    )


def raw_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same customers in the shape of the raw CSV extract."""
    return raw_shape(_given(spark, sf_dir))


def raw_shape(given: DataFrame) -> DataFrame:
    return given.selectExpr(*select_list(RAW))
