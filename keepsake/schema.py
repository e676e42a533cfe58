"""Table shapes, lookup rows and fixed names shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("customerID", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("SeniorCitizen", T.IntegerType()),
        T.StructField("Partner", T.StringType()),
        T.StructField("Dependents", T.StringType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("PhoneService", T.StringType()),
        T.StructField("MultipleLines", T.StringType()),
        T.StructField("InternetService", T.StringType()),
        T.StructField("OnlineSecurity", T.StringType()),
        T.StructField("OnlineBackup", T.StringType()),
        T.StructField("DeviceProtection", T.StringType()),
        T.StructField("TechSupport", T.StringType()),
        T.StructField("StreamingTV", T.StringType()),
        T.StructField("StreamingMovies", T.StringType()),
        T.StructField("Contract", T.StringType()),
        T.StructField("PaperlessBilling", T.StringType()),
        T.StructField("PaymentMethod", T.StringType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", T.StringType()),
        T.StructField("Churn", T.StringType()),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("senior_citizen", T.BooleanType()),
        T.StructField("partner", T.BooleanType()),
        T.StructField("dependents", T.BooleanType()),
        T.StructField("tenure_months", T.IntegerType()),
        T.StructField("monthly_charges", T.DoubleType()),
        T.StructField("total_charges", T.DoubleType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("paperless_billing", T.BooleanType()),
        T.StructField("phone_service", T.BooleanType()),
        T.StructField("multiple_lines", T.BooleanType()),
        T.StructField("internet_service", T.StringType()),
        T.StructField("online_security", T.BooleanType()),
        T.StructField("online_backup", T.BooleanType()),
        T.StructField("device_protection", T.BooleanType()),
        T.StructField("tech_support", T.BooleanType()),
        T.StructField("streaming_tv", T.BooleanType()),
        T.StructField("streaming_movies", T.BooleanType()),
    ]
)

# Lookup rows.
CONTRACT_TYPES = [
    (1, "Month-to-month", "No commitment, can cancel anytime"),
    (2, "One year", "One year commitment with potential discount"),
    (3, "Two year", "Two year commitment with maximum discount"),
]
SERVICE_TYPES = [
    (1, "PhoneService", "phone", "Basic phone service"),
    (2, "MultipleLines", "phone", "Multiple phone lines"),
    (3, "InternetService_DSL", "internet", "DSL Internet connection"),
    (4, "InternetService_Fiber", "internet", "Fiber optic Internet connection"),
    (5, "InternetService_No", "internet", "No internet service"),
    (6, "OnlineSecurity", "support", "Online security add-on"),
    (7, "OnlineBackup", "support", "Online backup add-on"),
    (8, "DeviceProtection", "support", "Device protection plan"),
    (9, "TechSupport", "support", "Technical support add-on"),
    (10, "StreamingTV", "streaming", "TV streaming service"),
    (11, "StreamingMovies", "streaming", "Movie streaming service"),
]

# Profile flag -> service name behind it.
SERVICE_FLAGS = {
    "has_phone_service": "PhoneService",
    "has_multiple_lines": "MultipleLines",
    "has_dsl": "InternetService_DSL",
    "has_fiber": "InternetService_Fiber",
    "has_online_security": "OnlineSecurity",
    "has_online_backup": "OnlineBackup",
    "has_device_protection": "DeviceProtection",
    "has_tech_support": "TechSupport",
    "has_streaming_tv": "StreamingTV",
    "has_streaming_movies": "StreamingMovies",
}

# The model's input columns, in model order.
NUMERIC_FEATURES = [
    "tenure_months", "tenure_years", "tenure_bucket", "tenure_quartile",
    "monthly_charges", "total_charges", "avg_monthly_spend",
    "charge_per_service", "estimated_clv", "monthly_charge_quartile",
    "total_services", "service_diversity", "premium_service_count",
    "risk_score", "risk_factors_count", "tenure_contract_interaction",
]
BINARY_FEATURES = [
    "gender_male", "is_senior", "has_partner", "has_dependents", "has_family", "senior_alone",
    "phone_service_flag", "multiple_lines_flag", "has_internet", "internet_fiber", "internet_dsl",
    "online_security_flag", "online_backup_flag", "device_protection_flag", "tech_support_flag",
    "streaming_tv_flag", "streaming_movies_flag",
    "has_security_bundle", "has_support_bundle", "has_streaming_bundle",
    "contract_length", "is_month_to_month", "has_long_contract",
    "payment_electronic_check", "payment_mailed_check", "payment_bank_transfer", "payment_credit_card",
    "has_auto_payment", "paperless_billing_flag",
    "is_new_customer", "is_established", "is_loyal", "is_high_value", "spending_trend",
    "risk_mtm", "risk_new", "risk_echeck", "risk_no_support", "risk_high_charge", "risk_fiber",
    "high_risk_flag", "new_high_value", "mtm_high_value", "senior_mtm", "fiber_no_support",
]
FEATURES = NUMERIC_FEATURES + BINARY_FEATURES

RISK_LEVELS = ["Low", "Medium", "High", "Critical"]

# Quality targets for a trained model.
METRIC_TARGETS = {"roc_auc": 0.80, "recall": 0.75, "precision": 0.60, "f1": 0.65}


@dataclass(frozen=True)
class Tables:
    """The normalised tables every view and analytic query starts from."""

    customers: DataFrame
    customer_contracts: DataFrame
    customer_services: DataFrame
    contract_types: DataFrame
    service_types: DataFrame


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few constant rows as part of the plan itself: no job, and the optimizer knows their size."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, float):
            return f"{value!r}D"
        if isinstance(value, int):
            return str(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS rows({', '.join(names)})")


def contract_types(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, CONTRACT_TYPES, ["contract_type_id", "contract_name", "description"])


def service_types(spark: SparkSession) -> DataFrame:
    return literal_rows(
        spark,
        [(*row, True) for row in SERVICE_TYPES],
        ["service_type_id", "service_name", "service_category", "description", "is_active"],
    )
