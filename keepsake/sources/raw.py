"""Cleaning of the raw extract and its split into normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake import schema
from keepsake.schema import RAW_SCHEMA, Tables
from keepsake.storage import stored

# Columns that hold Yes/No.
YES_NO_COLUMNS = ["partner", "dependents", "phoneservice", "paperlessbilling", "churn"]

# Add-on column -> service id.
ADD_ON_IDS = {
    "onlinesecurity": 6,
    "onlinebackup": 7,
    "deviceprotection": 8,
    "techsupport": 9,
    "streamingtv": 10,
    "streamingmovies": 11,
}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV extract with a header; the total stays text because some values do not parse.

    The total's blank is a value (it marks a fresh customer), so whitespace is kept.
    """
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_raw_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The well-formed lines as `read_raw` gives them, and the others: line and reason.

    A line is malformed if it has more or fewer fields than the header, or a field that is not
    of its column's type; accepted and rejected lines add up to all lines. The parsed lines are
    written once, as Spark cannot tell the two apart without parsing all columns.
    """
    names = RAW_SCHEMA.names
    parsed = stored(
        spark.read.schema(T.StructType([*RAW_SCHEMA.fields, T.StructField("_line", T.StringType())]))
        .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path),
        "raw-lines",
    )
    fields = F.size(F.split("_line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    reason = (
        F.when(fields < len(names), "too few fields").when(fields > len(names), "too many fields").otherwise("not of its type")
    )
    rejected = parsed.filter(F.col("_line").isNotNull()).select(F.col("_line").alias("line"), reason.alias("reason"))
    return parsed.filter(F.col("_line").isNull()).select(*names), rejected


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def coerce_charges(df: DataFrame) -> DataFrame:
    """Text totals to numbers; what does not parse becomes monthly * tenure, then 0."""
    parsed = F.col("totalcharges").try_cast("double")
    return df.withColumn(
        "totalcharges",
        F.coalesce(parsed, F.col("monthlycharges") * F.col("tenure"), F.lit(0.0)),
    )


def yes_no_to_bool(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    def flag(name: str) -> Column:
        return F.when(F.col(name) == "Yes", True).when(F.col(name) == "No", False)

    wanted = [c for c in (columns or YES_NO_COLUMNS) if c in df.columns]
    return df.withColumns({c: flag(c) for c in wanted})


def int_to_bool(df: DataFrame, column: str = "seniorcitizen") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("boolean"))


def clean(raw: DataFrame) -> DataFrame:
    return int_to_bool(yes_no_to_bool(coerce_charges(normalise_columns(raw))))


def to_customers(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        F.col("customerid").alias("customer_id"),
        "gender",
        F.col("seniorcitizen").alias("senior_citizen"),
        "partner",
        "dependents",
        F.col("tenure").alias("tenure_months"),
        F.col("monthlycharges").cast("decimal(10,2)").alias("monthly_charges"),
        F.col("totalcharges").cast("decimal(10,2)").alias("total_charges"),
        "churn",
    )


def hash_order(key: Column | str, seed: int) -> Column:
    """A reproducible 32-bit shuffle key per id: the same in every run and on every executor."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key) if isinstance(key, str) else key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def assign_churn_date(customers: DataFrame, as_of: str, seed: int = 42) -> DataFrame:
    """Churned customers left 1 to 90 days before `as_of`; the day is drawn from the id."""
    days = (hash_order("customer_id", seed) % 90 + 1).cast("int")
    return customers.withColumn(
        "churn_date", F.when(F.col("churn"), F.date_sub(F.lit(as_of).cast("date"), days))
    )


def to_contracts(cleaned: DataFrame, contract_types: DataFrame, as_of: str) -> DataFrame:
    """One contract per customer; an unknown contract name keeps its row with a null id."""
    names = contract_types.select("contract_type_id", F.col("contract_name").alias("contract"))
    return cleaned.join(names, "contract", "left").select(
        F.col("customerid").alias("customer_id"),
        "contract_type_id",
        F.col("paymentmethod").alias("payment_method"),
        F.col("paperlessbilling").alias("paperless_billing"),
        F.date_sub(F.lit(as_of).cast("date"), (F.col("tenure") * 30).cast("int")).alias("contract_start_date"),
        F.lit(None).cast("date").alias("contract_end_date"),
    )


def to_services(cleaned: DataFrame) -> DataFrame:
    """Wide service columns to one row per held service, without leaving the row's own task."""
    phone = F.coalesce(F.col("phoneservice"), F.lit(False))
    internet = F.coalesce(F.col("internetservice"), F.lit(""))
    held: list[tuple[Column, int]] = [
        (phone, 1),
        (phone & (F.col("multiplelines") == "Yes"), 2),
        (internet == "DSL", 3),
        (internet == "Fiber optic", 4),
        (~internet.isin("DSL", "Fiber optic"), 5),
    ]
    held += [((internet != "No") & (F.col(c) == "Yes"), i) for c, i in ADD_ON_IDS.items()]
    ids = F.array_compact(F.array(*[F.when(condition, F.lit(i)) for condition, i in held]))
    return cleaned.select(
        F.col("customerid").alias("customer_id"), F.explode(ids).alias("service_type_id")
    ).withColumn("is_subscribed", F.lit(True))


def ingest(raw: DataFrame, as_of: str, seed: int = 42) -> Tables:
    spark = raw.sparkSession
    cleaned = clean(raw)
    contract_types = schema.contract_types(spark)
    return Tables(
        customers=assign_churn_date(to_customers(cleaned), as_of, seed),
        customer_contracts=to_contracts(cleaned, contract_types, as_of),
        customer_services=to_services(cleaned),
        contract_types=contract_types,
        service_types=schema.service_types(spark),
    )
