"""Row counts and constraint checks as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.metrics import count_if, percent_of_count
from keepsake.schema import Tables


def table_counts(tables: Tables) -> DataFrame:
    """Rows per table, with the churn rate on the customers row."""
    customers = tables.customers.agg(
        F.count(F.lit(1)).alias("row_count"),
        count_if(F.col("churn")).alias("churned"),
        percent_of_count(count_if(F.col("churn")), F.count(F.lit(1))).alias("churn_rate_pct"),
    ).select(F.lit("customers").alias("table_name"), "*")
    others = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in (
            ("customer_contracts", tables.customer_contracts),
            ("customer_services", tables.customer_services),
        )
    ]
    out = customers
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def request_rules() -> dict[str, Column]:
    """Violations that keep a scoring request from being accepted."""
    return {
        "tenure_0_to_72": ~F.coalesce(F.col("tenure_months").between(0, 72), F.lit(False)),
        "monthly_not_negative": ~F.coalesce(F.col("monthly_charges") >= 0, F.lit(False)),
        "total_not_negative": ~F.coalesce(F.col("total_charges") >= 0, F.lit(False)),
        "contract_given": F.col("contract_type").isNull(),
        "payment_given": F.col("payment_method").isNull(),
    }


def _broken() -> Column:
    """Names of the rules that a request breaks."""
    return F.array_compact(F.array(*[F.when(violated, F.lit(rule)) for rule, violated in request_rules().items()]))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests that break no rule; `rejected_requests` has the others."""
    kept = None
    for violated in request_rules().values():
        kept = ~violated if kept is None else kept & ~violated
    return requests.filter(kept)


def rejected_requests(requests: DataFrame) -> DataFrame:
    """The requests that are not scored, each with the rules that it breaks."""
    return requests.withColumn("broken_rules", _broken()).filter(F.size("broken_rules") > 0)


def check_batch_size(requests: DataFrame, most: int = 100) -> DataFrame:
    """Request-size rule of the online batch call: 1..most records."""
    return requests.agg(F.count(F.lit(1)).alias("records")).select(
        "records", (~F.col("records").between(1, most)).alias("violated")
    )


def _fails(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def _unknown(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Adds `_known`: whether the key is in the lookup table."""
    return df.join(lookup.select(key, F.lit(True).alias("_known")), key, "left")


def check_rules(tables: Tables, predictions: DataFrame | None = None) -> DataFrame:
    """Every table constraint with its number of violating rows.

    Each table is read once. Its rows bring a count per rule and per table to one grouping by
    customer (combined before the shuffle, so a hot key is one row per task), which also
    tells repeated ids and rows whose customer is missing.
    """
    pairs = tables.customer_services.groupBy("customer_id", "service_type_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = _unknown(pairs, tables.service_types, "service_type_id")
    one = F.lit(1).cast("long")
    sources: dict[str, tuple[DataFrame, Column, dict[str, Column]]] = {
        "customers": (tables.customers, one, {
            "gender_domain": _fails(F.col("gender").isin("Male", "Female")),
            "tenure_not_negative": _fails(F.col("tenure_months") >= 0),
            "tenure_at_most_72": F.col("tenure_months") > 72,
            "monthly_not_negative": _fails(F.col("monthly_charges") >= 0),
            "total_not_negative": F.col("total_charges") < 0,
        }),
        "customer_contracts": (_unknown(tables.customer_contracts, tables.contract_types, "contract_type_id"), one, {
            "contract_type_given": F.col("contract_type_id").isNull(),
            "payment_given": F.col("payment_method").isNull(),
            "known_contract_type_id": F.col("_known").isNull(),
        }),
        "customer_services": (pairs, F.col("n"), {
            "known_service_type_id": F.col("_known").isNull(),
        }),
    }
    if predictions is not None:
        sources["predictions"] = (predictions, one, {
            "probability_0_to_1": _fails(F.col("churn_probability").between(0, 1)),
            "risk_level_domain": _fails(F.col("risk_level").isin("low", "medium", "high")),
        })
    stacked = None
    for table, (df, n, rules) in sources.items():
        counted = {f"{table}.rows": n} | {f"{table}.{r}": F.when(v, n).otherwise(0).cast("long") for r, v in rules.items()}
        if table == "customer_services":
            counted[f"{table}.unique_customer_id_service_type_id"] = n - 1
        part = df.select("customer_id", *[c.alias(name) for name, c in counted.items()])
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    names = [c for c in stacked.columns if c != "customer_id"]
    nothing = F.lit(0).cast("long")
    each = stacked.groupBy("customer_id").agg(*[F.coalesce(F.sum(f"`{c}`"), nothing).alias(c) for c in names])
    found = {c: F.sum(f"`{c}`") for c in names if not c.endswith(".rows")}
    orphan = F.col("customer_id").isNull() | (F.col("`customers.rows`") == 0)
    for table in sources:
        rows = F.col(f"`{table}.rows`")
        if table in ("customers", "customer_contracts"):
            found[f"{table}.unique_customer_id"] = F.sum(F.greatest(rows - 1, nothing))
        if table != "customers":
            found[f"{table}.known_customer_id"] = F.sum(F.when(orphan, rows).otherwise(0))
    totals = each.agg(*[F.coalesce(v, nothing).cast("long").alias(c) for c, v in found.items()])
    rows = F.array(*[
        F.struct(
            F.lit(c.split(".")[0]).alias("table_name"), F.lit(c.split(".")[1]).alias("rule"),
            F.col(f"`{c}`").alias("violations"),
        )
        for c in found
    ])
    return totals.select(F.inline(rows))
