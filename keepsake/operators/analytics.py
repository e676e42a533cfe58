"""Churn, revenue, segment and adoption reports over the normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions import bands, ranking
from keepsake.functions.bands import first_match
from keepsake.functions.metrics import count_if, mean, percent, percent_of_count, sum_if
from keepsake.operators.views import with_contract, with_subscribed_rows
from keepsake.schema import Tables


def _lost() -> Column:
    return F.col("churn")


def _rows() -> Column:
    return F.count(F.lit(1))


def _churned(name: str = "churned") -> Column:
    return count_if(_lost()).alias(name)


def _churn_rate(name: str = "churn_rate_pct") -> Column:
    return percent_of_count(count_if(_lost()), _rows()).alias(name)


def overall_summary(tables: Tables) -> DataFrame:
    return tables.customers.agg(
        _rows().alias("total_customers"),
        _churned("churned_customers"),
        count_if(~_lost()).alias("retained_customers"),
        _churn_rate(),
        mean("monthly_charges").alias("avg_monthly_charges"),
        mean("total_charges").alias("avg_total_charges"),
    )


def churn_by_contract(tables: Tables) -> DataFrame:
    return (
        with_contract(tables, "inner")
        .groupBy("contract_name")
        .agg(_rows().alias("total_customers"), _churned(), _churn_rate())
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "contract_name")
    )


def churn_by_tenure(tables: Tables) -> DataFrame:
    bucket = bands.up_to(F.col("tenure_months"), bands.TENURE_BUCKETS)
    return (
        tables.customers.groupBy(bucket.alias("tenure_bucket"))
        .agg(
            _rows().alias("total_customers"),
            _churned(),
            _churn_rate(),
            mean("monthly_charges").alias("avg_monthly_charges"),
            F.min("tenure_months").alias("_first"),
        )
        .orderBy("_first")
        .drop("_first")
    )


def churn_by_payment(tables: Tables) -> DataFrame:
    return (
        tables.customers.join(tables.customer_contracts, "customer_id")
        .groupBy("payment_method")
        .agg(
            _rows().alias("total_customers"),
            _churned(),
            _churn_rate(),
            mean("monthly_charges").alias("avg_monthly_charges"),
            F.sum("total_charges").alias("total_revenue"),
        )
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "payment_method")
    )


def _metric_rows(one_row: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Turn one row of totals into (metric, value) rows: one scan instead of one per metric."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in metrics.items()])
    return one_row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


def revenue_impact(tables: Tables) -> DataFrame:
    totals = tables.customers.agg(
        sum_if(~_lost(), F.col("monthly_charges")).alias("kept"),
        sum_if(_lost(), F.col("monthly_charges")).alias("lost"),
        F.sum("monthly_charges").alias("all"),
    )
    money = "decimal(22,2)"
    return _metric_rows(
        totals,
        {
            "Current Monthly Revenue": F.col("kept").cast(money),
            "Lost Monthly Revenue (Churned)": F.col("lost").cast(money),
            "Potential Monthly Revenue (If No Churn)": F.col("all").cast(money),
            "Revenue Loss Percentage": percent(F.col("lost"), F.col("all")).cast(money),
        },
    )


def service_adoption(tables: Tables) -> DataFrame:
    """Churn with and without each service of the service table.

    A customer counts as "without" when a row says so or none exists. That equals the distinct
    counts over every customer x service pair, but the pairs are never built: the rows of a
    customer become one row of bits, one per service of the (small) service table, and "without"
    is all customers less those who only have rows that subscribe.
    """
    listed = tables.service_types.select("service_type_id", "service_name").filter("service_type_id is not null")
    ids = sorted(r["service_type_id"] for r in listed.select("service_type_id").distinct().collect())
    words = [ids[at : at + 63] for at in range(0, len(ids), 63)]
    held, nothing = F.coalesce("is_subscribed", F.lit(False)), F.lit(0).cast("long")

    def bit(word: list) -> Column:
        return F.coalesce(*[F.when(F.col("service_type_id") == s, F.lit(1 << i).cast("long")) for i, s in enumerate(word)], nothing)

    marks = {f"has_{w}": F.bit_or(F.when(held, bit(word)).otherwise(nothing)) for w, word in enumerate(words)}
    marks |= {f"refuses_{w}": F.bit_or(F.when(held, nothing).otherwise(bit(word))) for w, word in enumerate(words)}
    marks = marks or {"has_none": F.lit(None)}
    marked = tables.customer_services.groupBy("customer_id").agg(*[c.alias(n) for n, c in marks.items()])
    everyone = tables.customers.select("customer_id", "churn").join(marked, "customer_id", "left")

    def counted(name: str, who: Column) -> list[Column]:
        return [count_if(who).alias(name), count_if(who & _lost()).alias(f"{name}_lost")]

    sums = counted("everyone", F.lit(True))
    for w, word in enumerate(words):
        for i, s in enumerate(word):
            has, refuses = (F.coalesce(F.getbit(f"{kind}_{w}", F.lit(i)), F.lit(0)) == 1 for kind in ("has", "refuses"))
            sums += counted(f"with_{w}_{i}", has) + counted(f"only_{w}_{i}", has & ~refuses)
    per_service = [
        F.struct(
            F.lit(s).alias("service_type_id"), F.col(f"with_{w}_{i}").alias("customers_with_service"),
            F.col(f"with_{w}_{i}_lost").alias("churned_with_service"),
            (F.col("everyone") - F.col(f"only_{w}_{i}")).alias("customers_without_service"),
            (F.col("everyone_lost") - F.col(f"only_{w}_{i}_lost")).alias("churned_without_service"),
        )
        for w, word in enumerate(words) for i, s in enumerate(word)
    ]
    if not ids:
        per_service = [F.struct(F.lit(None).cast("int").alias("service_type_id"), *[
            nothing.alias(c) for c in ("customers_with_service", "churned_with_service", "customers_without_service", "churned_without_service")
        ])]
    counts = listed.join(everyone.agg(*sums).select(F.inline(F.array(*per_service))), "service_type_id")
    return counts.select(
        "service_name",
        "customers_with_service",
        "churned_with_service",
        percent_of_count(F.col("churned_with_service"), F.col("customers_with_service")).alias(
            "churn_rate_with_service"
        ),
        "customers_without_service",
        "churned_without_service",
        percent_of_count(F.col("churned_without_service"), F.col("customers_without_service")).alias(
            "churn_rate_without_service"
        ),
    ).orderBy("service_name")


def risk_segments(tables: Tables) -> DataFrame:
    monthly = F.col("contract_name") == "Month-to-month"
    tenure = F.col("tenure_months")
    segment = first_match(
        [
            ((tenure <= 6) & monthly & (F.col("monthly_charges") > 70), "Critical Risk"),
            ((tenure <= 12) & monthly, "High Risk"),
            (monthly | (tenure <= 12), "Medium Risk"),
            (None, "Low Risk"),
        ]
    )
    order = F.array_position(
        F.array(*[F.lit(s) for s in ("Critical Risk", "High Risk", "Medium Risk", "Low Risk")]),
        F.col("risk_segment"),
    )
    return (
        with_contract(tables, "inner")
        .groupBy(segment.alias("risk_segment"))
        .agg(
            _rows().alias("customer_count"),
            _churned("actually_churned"),
            _churn_rate("actual_churn_rate"),
            mean("monthly_charges").alias("avg_monthly_charges"),
            F.sum("monthly_charges").alias("total_monthly_revenue"),
        )
        .orderBy(order)
    )


def demographics(tables: Tables) -> DataFrame:
    status = first_match(
        [
            (F.col("partner") & F.col("dependents"), "Family (Partner + Dependents)"),
            (F.col("partner"), "With Partner Only"),
            (F.col("dependents"), "With Dependents Only"),
            (None, "Single"),
        ]
    )
    return (
        tables.customers.groupBy("gender", "senior_citizen", status.alias("family_status"))
        .agg(_rows().alias("total_customers"), _churned(), _churn_rate())
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "gender", "senior_citizen", "family_status")
    )


def _with_clv(tables: Tables) -> DataFrame:
    spent = F.col("total_charges")
    clv = F.when(_lost(), spent).otherwise(spent + F.col("monthly_charges") * 12)
    return with_contract(tables, "inner").select(
        "customer_id", "churn", clv.cast("decimal(14,2)").alias("estimated_clv")
    )


def clv_ranks(tables: Tables) -> DataFrame:
    """Quartile and rank of every customer by lifetime value, highest (and unknown) first."""
    falling = -F.col("estimated_clv")
    valued = ranking.add_ntiles(_with_clv(tables), 4, {"clv_quartile": falling}, "customer_id")
    return ranking.add_rank(valued, falling, "clv_rank").select(
        "customer_id", "estimated_clv", "clv_quartile", "clv_rank"
    )


def clv_quartiles(tables: Tables) -> DataFrame:
    valued = ranking.add_ntiles(
        _with_clv(tables), 4, {"clv_quartile": -F.col("estimated_clv")}, "customer_id"
    )
    label = first_match(
        [
            (F.col("clv_quartile") == 1, "Top 25% (Premium)"),
            (F.col("clv_quartile") == 2, "25-50% (High Value)"),
            (F.col("clv_quartile") == 3, "50-75% (Medium Value)"),
            (None, "Bottom 25% (Low Value)"),
        ]
    )
    return (
        valued.groupBy("clv_quartile")
        .agg(
            _rows().alias("customers"),
            _churned(),
            _churn_rate(),
            mean("estimated_clv").alias("avg_clv"),
            F.sum("estimated_clv").alias("total_clv_at_risk"),
        )
        .select("clv_quartile", label.alias("value_segment"), "customers", "churned", "churn_rate_pct",
                "avg_clv", "total_clv_at_risk")
        .orderBy("clv_quartile")
    )


def rfm_scores(tables: Tables) -> DataFrame:
    """Fifths by tenure, subscribed services and charge, with the segment they lead to."""
    scored = ranking.add_ntiles(
        with_subscribed_rows(tables.customers, tables),
        5,
        {
            "r_score": F.col("tenure_months"),
            "f_score": F.col("subscribed_rows"),
            "m_score": F.col("monthly_charges"),
        },
        "customer_id",
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    segment = first_match(
        [
            ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
            ((r >= 4) & (f >= 3) & (m >= 3), "Loyal Customers"),
            ((r >= 3) & (m >= 4), "Big Spenders"),
            ((r <= 2) & (f <= 2), "At Risk"),
            ((r <= 2) & (m >= 3), "High Value At Risk"),
            (None, "Regular"),
        ]
    )
    return scored.select("*", (r + f + m).alias("rfm_total"), segment.alias("rfm_segment"))


def rfm_segments(tables: Tables) -> DataFrame:
    return (
        rfm_scores(tables)
        .groupBy("rfm_segment")
        .agg(
            _rows().alias("customers"),
            _churned(),
            _churn_rate(),
            mean("monthly_charges").alias("avg_monthly_charges"),
            mean("subscribed_rows", 1).alias("avg_services"),
            mean("tenure_months", 1).alias("avg_tenure"),
        )
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "rfm_segment")
    )


def charge_bands(tables: Tables) -> DataFrame:
    """Charge bands with running totals; the windows see the five aggregated rows only."""
    monthly = F.col("monthly_charges")
    grouped = tables.customers.groupBy(
        bands.up_to(monthly, bands.CHARGE_BANDS, inclusive=False).alias("charge_band"),
        bands.up_to(monthly, bands.CHARGE_BANDS, labels=False, inclusive=False).alias("band_order"),
    ).agg(_rows().alias("customers"), _churned(), F.sum(monthly).alias("monthly_revenue"))
    so_far = W.orderBy("band_order").rangeBetween(W.unboundedPreceding, W.currentRow)
    exact_rate = F.try_divide(
        F.lit(100) * F.col("churned").cast("decimal(18,0)"), F.col("customers").cast("decimal(18,0)")
    )
    ran = grouped.select(
        "*",
        F.sum("customers").over(so_far).alias("cumulative_customers"),
        F.sum("churned").over(so_far).alias("cumulative_churned"),
        (exact_rate - F.lag(exact_rate).over(W.orderBy("band_order"))).alias("_change"),
    )
    return (
        ran.orderBy("band_order")
        .select(
            "charge_band",
            "customers",
            "churned",
            percent_of_count(F.col("churned"), F.col("customers")).alias("churn_rate_pct"),
            "monthly_revenue",
            "cumulative_customers",
            "cumulative_churned",
            percent_of_count(F.col("cumulative_churned"), F.col("cumulative_customers")).alias(
                "cumulative_churn_rate"
            ),
            F.round("_change", 2).alias("churn_rate_change"),
        )
    )


def bundle_sizes(tables: Tables) -> DataFrame:
    return (
        with_subscribed_rows(tables.customers, tables)
        .groupBy(F.col("subscribed_rows").alias("service_count"))
        .agg(_rows().alias("customers"), _churned(), _churn_rate(), mean("monthly_charges").alias("avg_monthly_charges"))
        .orderBy("service_count")
    )


def service_bundles(tables: Tables) -> DataFrame:
    """How common each exact bundle is, and its churn. A customer's set is at most the lookup's length."""
    names = tables.service_types.select("service_type_id", "service_name")
    bundles = (
        tables.customer_services.filter("is_subscribed")
        .join(names, "service_type_id")
        .groupBy("customer_id")
        .agg(F.array_join(F.array_sort(F.collect_set("service_name")), " + ").alias("service_bundle"))
    )
    return (
        tables.customers.join(bundles, "customer_id", "left")
        .groupBy("service_bundle")
        .agg(_rows().alias("customers"), _churned(), _churn_rate())
        .orderBy(F.desc("customers"), F.asc_nulls_last("service_bundle"))
    )


def tenure_cohorts(tables: Tables) -> DataFrame:
    tenure, monthly = F.col("tenure_months"), F.col("monthly_charges")
    return (
        tables.customers.groupBy(
            bands.at_least(tenure, bands.TENURE_COHORTS).alias("cohort"),
            bands.at_least(tenure, bands.TENURE_COHORTS, labels=False).alias("cohort_order"),
        )
        .agg(
            _rows().alias("total_customers"),
            count_if(~_lost()).alias("retained"),
            _churned(),
            percent_of_count(count_if(~_lost()), _rows()).alias("retention_rate_pct"),
            sum_if(~_lost(), monthly).alias("active_revenue"),
            sum_if(_lost(), monthly).alias("lost_revenue"),
        )
        .orderBy("cohort_order")
        .drop("cohort_order")
    )


def contract_opportunities(tables: Tables) -> DataFrame:
    """Which contract change to offer the active customers."""
    monthly = F.col("contract_name") == "Month-to-month"
    tenure, charge = F.col("tenure_months"), F.col("monthly_charges")
    offer = first_match(
        [
            (monthly & (tenure >= 12) & (charge >= 70), "Upgrade to Annual (High Value Loyal)"),
            (monthly & (tenure <= 6) & (charge >= 80), "Urgent: Offer Contract Incentive"),
            ((F.col("contract_name") == "One year") & (tenure >= 24), "Upgrade to 2-Year Contract"),
            (monthly & (F.col("payment_method") == "Electronic check"), "Convert Payment Method + Offer Contract"),
            (None, "No Action Needed"),
        ]
    )
    active = with_contract(tables, "inner").filter(~_lost())
    return (
        with_subscribed_rows(active, tables)
        .groupBy(offer.alias("recommendation"))
        .agg(
            _rows().alias("customer_count"),
            mean("monthly_charges").alias("avg_monthly_charges"),
            F.sum("monthly_charges").alias("total_monthly_value"),
            mean("tenure_months", 1).alias("avg_tenure"),
            mean("subscribed_rows", 1).alias("avg_services"),
        )
        .orderBy(F.desc_nulls_first("total_monthly_value"), "recommendation")
    )


def executive_kpis(tables: Tables) -> DataFrame:
    """Twelve (metric, text) rows from one conditional aggregation.

    Totals run over all customers; the contract figures only see those whose contract is
    known, which is why the join is outer and their conditions name the contract.
    """
    monthly = F.coalesce(F.col("contract_name") == "Month-to-month", F.lit(False))
    charge = F.col("monthly_charges")
    exposed = monthly & ~_lost() & (charge >= 70) & (F.col("tenure_months") <= 12)
    totals = with_contract(tables).agg(
        _rows().alias("n"),
        count_if(~_lost()).alias("active"),
        count_if(_lost()).alias("churned"),
        sum_if(~_lost(), charge).alias("active_mrr"),
        sum_if(_lost(), charge).alias("lost_mrr"),
        F.sum("total_charges").alias("lifetime"),
        mean("tenure_months", 1).alias("tenure"),
        count_if(monthly).alias("mtm"),
        count_if(monthly & _lost()).alias("mtm_churned"),
        count_if(exposed).alias("exposed"),
        F.sum(F.when(exposed, charge)).alias("exposed_mrr"),
    )

    def text(value: Column, kind: str) -> Column:
        return value.cast(kind).cast("string")

    money, count, tenths = "decimal(22,2)", "bigint", "decimal(18,1)"
    return _metric_rows(
        totals,
        {
            "Total Customers": text(F.col("n"), count),
            "Active Customers": text(F.col("active"), count),
            "Churned Customers": text(F.col("churned"), count),
            "Churn Rate (%)": text(percent_of_count(F.col("churned"), F.col("n")), money),
            "Monthly Recurring Revenue ($)": text(F.col("active_mrr"), money),
            "Lost Monthly Revenue ($)": text(F.col("lost_mrr"), money),
            "Lifetime Revenue ($)": text(F.col("lifetime"), money),
            "Avg Customer Tenure (months)": text(F.col("tenure"), tenths),
            "Month-to-Month Customers": text(F.col("mtm"), count),
            "Month-to-Month Churn Rate (%)": text(percent_of_count(F.col("mtm_churned"), F.col("mtm")), money),
            "High-Value At-Risk Customers": text(F.col("exposed"), count),
            "High-Value At-Risk Revenue ($)": text(F.col("exposed_mrr"), money),
        },
    )


def loyal_low_spenders(tables: Tables) -> DataFrame:
    """Customers in the longer-tenured half whose total spend is in the lowest quarter."""
    scored = ranking.add_ntiles(
        tables.customers.select("customer_id", "tenure_months", "total_charges"),
        4,
        {"recency_score": -F.col("tenure_months"), "monetary_score": -F.col("total_charges")},
        "customer_id",
    )
    return scored.filter("monetary_score = 4 AND recency_score <= 2").select(
        "customer_id", "recency_score", "monetary_score"
    )
