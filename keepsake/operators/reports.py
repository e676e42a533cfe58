"""The tables behind the risk, model and what-if pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import bands
from keepsake.functions.metrics import count_if
from keepsake.operators.features import ADD_ONS, select_features, with_features
from keepsake.operators.scoring import LinearModel, score
from keepsake.schema import literal_rows
from keepsake.sources.quality import valid_requests


# Texts of the recommendations and suggestions.
RETENTION_ADVICE = {
    "contract": "Offer contract upgrade with discount",
    "payment": "Suggest auto-payment for small discount",
    "support": "Offer free tech support trial",
    "security": "Bundle discounted security services",
    "new": "New customer engagement program",
    "none": "Customer profile looks healthy",
}
WHAT_IF_ADVICE = {
    "contract": "Change to One year or Two year contract",
    "payment": "Switch to automatic payment",
    "support": "Add Tech Support",
    "security": "Add Online Security",
    "none": "Profile already optimized!",
}
# Scenarios that replace contract and payment.
SCENARIOS = [
    ("MTM + E-check", "Month-to-month", "Electronic check"),
    ("MTM + Auto-pay", "Month-to-month", "Bank transfer (automatic)"),
    ("1-year + Auto-pay", "One year", "Bank transfer (automatic)"),
    ("2-year + Auto-pay", "Two year", "Bank transfer (automatic)"),
]
# Keywords per feature category.
FEATURE_CATEGORIES = {
    "Demographics": ["gender", "senior", "partner", "dependent", "family"],
    "Services": ["phone", "internet", "security", "backup", "protection", "support", "streaming"],
    "Contract": ["contract", "mtm", "long"],
    "Payment": ["payment", "paperless", "auto"],
    "Tenure": ["tenure", "new", "established", "loyal"],
    "Financial": ["charge", "spend", "clv", "value"],
    "Risk": ["risk"],
}


def _p() -> Column:
    return F.col("churn_probability")


def risk_kpis(scored: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    high, critical = count_if(_p() >= 0.5), count_if(_p() >= 0.75)

    def share(part: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(part * 100.0, n), F.lit(0.0)), 1)

    return scored.agg(
        n.alias("total_customers"),
        high.alias("high_risk"),
        critical.alias("critical_risk"),
        share(high).alias("high_risk_pct"),
        share(critical).alias("critical_risk_pct"),
        F.round(F.avg(_p()), 4).alias("avg_probability"),
        F.round(F.coalesce(F.sum(F.when(_p() >= 0.5, F.col("monthly_charges"))), F.lit(0.0)), 2).alias(
            "revenue_at_risk"
        ),
    )


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Counts for the four report bins, in bin order, empty bins included."""
    rows = [(i, label) for i, (_, label) in enumerate(bands.REPORT_BINS, start=1)]
    bins = literal_rows(scored.sparkSession, rows, ["bin_order", "risk_category"])
    counts = scored.groupBy(bands.report_bin(_p()).alias("risk_category")).agg(F.count(F.lit(1)).alias("n"))
    return (
        bins.join(counts, "risk_category", "left")
        .orderBy("bin_order")
        .select("risk_category", F.coalesce("n", F.lit(0)).alias("n"))
    )


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bins 0 to bins - 1 over [low, high]; the top edge belongs to the last bin.

    Bin -1 counts the values below, bin `bins` those above (NaN too), and bin null the
    missing ones, so the counts add up to the rows.
    """
    inside = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))
    at = F.when(value < low, F.lit(-1)).when(value > high, F.lit(bins)).when(value.isNotNull(), inside)
    return (
        df.groupBy(at.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
    )


def probability_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(scored, _p(), 0.0, 1.0, bins)


def risk_by(scored: DataFrame, column: str) -> DataFrame:
    return (
        scored.groupBy(column)
        .agg(F.round(F.avg(_p()), 4).alias("avg_churn_risk"), F.count(F.lit(1)).alias("n"))
        .orderBy(column)
    )


def top_at_risk(scored: DataFrame, n: int = 10) -> DataFrame:
    return (
        scored.orderBy(F.desc("churn_probability"), "customer_id")
        .limit(n)
        .select("customer_id", "churn_probability", "risk_level", "contract_type", "monthly_charges")
    )


def risk_list(
    scored: DataFrame,
    min_probability: float = 0.5,
    levels: list[str] | None = None,
    id_contains: str = "",
    max_rows: int | None = None,
) -> DataFrame:
    """Filtered risk list, most at risk first; all of it unless the caller names a limit."""
    kept = scored.filter(_p() >= min_probability)
    if levels:
        kept = kept.filter(F.upper("risk_level").isin([level.upper() for level in levels]))
    if id_contains:
        kept = kept.filter(F.contains(F.lower("customer_id"), F.lit(id_contains.lower())))
    listed = kept.orderBy(F.desc("churn_probability"), "customer_id")
    if max_rows is not None:
        listed = listed.limit(max_rows)
    return listed.select(
        "customer_id", "churn_probability", "risk_level", "contract_type", "tenure_months",
        "monthly_charges", "payment_method",
    )


def risk_list_stats(listed: DataFrame) -> DataFrame:
    level = F.upper("risk_level")
    return listed.agg(
        F.count(F.lit(1)).alias("shown"),
        count_if(level == "CRITICAL").alias("critical"),
        count_if(level == "HIGH").alias("high"),
        F.round(F.coalesce(F.avg(_p()), F.lit(0.0)), 4).alias("avg_probability"),
    )


def _advice(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    given = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in rules]))
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(otherwise)))


def retention_advice(requests: DataFrame) -> DataFrame:
    """Add `recommendations` for every customer."""
    a = RETENTION_ADVICE
    return requests.withColumn(
        "recommendations",
        _advice(
            [
                (F.col("contract_type") == "Month-to-month", a["contract"]),
                (F.col("payment_method") == "Electronic check", a["payment"]),
                (~F.coalesce("tech_support", F.lit(False)), a["support"]),
                (~F.coalesce("online_security", F.lit(False)), a["security"]),
                (F.col("tenure_months") < 12, a["new"]),
            ],
            a["none"],
        ),
    )


def what_if_inputs(requests: DataFrame) -> DataFrame:
    """Input rule of the simulator: no extra lines without a phone, no add-ons without internet."""
    online = F.col("internet_service") != "No"
    changed = {"multiple_lines": F.when(F.col("phone_service"), F.col("multiple_lines")).otherwise(False)}
    changed.update({c: F.when(online, F.col(c)).otherwise(False) for c in ADD_ONS})
    return requests.withColumns(changed)


def what_if_advice(requests: DataFrame) -> DataFrame:
    a = WHAT_IF_ADVICE
    online = F.col("internet_service") != "No"
    return requests.withColumn(
        "suggestions",
        _advice(
            [
                (F.col("contract_type") == "Month-to-month", a["contract"]),
                (F.col("payment_method") == "Electronic check", a["payment"]),
                (~F.col("tech_support") & online, a["support"]),
                (~F.col("online_security") & online, a["security"]),
            ],
            a["none"],
        ),
    )


def scenarios(requests: DataFrame, model: LinearModel) -> DataFrame:
    """Every customer under every contract/payment scenario, re-scored.

    The four variants are exploded inside the customer's row, so nothing is shuffled.
    """
    variants = F.array(
        *[
            F.struct(
                F.lit(i).alias("scenario_order"), F.lit(s).alias("scenario"),
                F.lit(c).alias("contract_type"), F.lit(p).alias("payment_method"),
            )
            for i, (s, c, p) in enumerate(SCENARIOS, start=1)
        ]
    )
    varied = (
        what_if_inputs(valid_requests(requests))
        .drop("contract_type", "payment_method")
        .select("*", F.explode(variants).alias("v"))
        .select("*", "v.*")
        .drop("v")
    )
    kept = ("scenario_order", "scenario")
    built = with_features(varied, "serve", keep=kept)
    return score(select_features(built, keep=kept)[0], model).select(
        "customer_id", "scenario_order", "scenario", F.round("probability", 4).alias("risk")
    )


def best_scenario(compared: DataFrame) -> DataFrame:
    """The scenario with the least risk per customer (the first one on a tie)."""
    order = F.struct("risk", "scenario_order")
    return compared.groupBy("customer_id").agg(
        F.min_by("scenario", order).alias("best_scenario"), F.min("risk").alias("best_risk")
    )


def feature_categories(features: DataFrame) -> DataFrame:
    """Features per category by keyword and their measured importance, summed; one feature may
    count in several."""
    name = F.lower("feature")

    def belongs(keywords: list[str]) -> Column:
        held = F.contains(name, F.lit(keywords[0]))
        for keyword in keywords[1:]:
            held = held | F.contains(name, F.lit(keyword))
        return held

    categories = F.array_compact(
        F.array(*[F.when(belongs(k), F.lit(c)) for c, k in FEATURE_CATEGORIES.items()])
    )
    return (
        features.select(F.explode(categories).alias("category"), "importance")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("importance"))
        .orderBy("category")
    )
