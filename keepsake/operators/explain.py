"""Attribution of linear scores, ranked reasons and global importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators.features import computed_once
from keepsake.operators.scoring import LinearModel

# Readable names, online and in the batch tool.
ONLINE_NAMES = {
    "is_month_to_month": "Month-to-month contract",
    "contract_length": "Contract length",
    "tenure_months": "Customer tenure",
    "monthly_charges": "Monthly charges",
    "total_services": "Number of services",
    "has_internet": "Internet service",
    "internet_fiber": "Fiber optic internet",
    "payment_electronic_check": "Electronic check payment",
    "tech_support_flag": "Tech support service",
    "online_security_flag": "Online security service",
    "has_partner": "Has partner",
    "is_senior": "Senior citizen",
    "risk_score": "Overall risk score",
    "is_new_customer": "New customer (< 6 months)",
    "has_security_bundle": "Security bundle",
    "has_support_bundle": "Support bundle",
    "risk_mtm": "Month-to-month risk factor",
    "risk_echeck": "Electronic check risk factor",
    "risk_fiber": "Fiber optic risk factor",
}
BATCH_NAMES = {
    "is_month_to_month": "Month-to-month contract",
    "contract_length": "Contract length",
    "tenure_months": "Customer tenure",
    "monthly_charges": "Monthly charges",
    "total_services": "Number of services",
    "has_internet": "Has internet service",
    "internet_fiber": "Has fiber optic internet",
    "payment_electronic_check": "Pays by electronic check",
    "has_tech_support": "Has tech support",
    "online_security_flag": "Has online security",
    "has_partner": "Has partner",
    "is_senior": "Is senior citizen",
    "risk_score": "Overall risk score",
    "is_new_customer": "Is new customer",
}


def attribution(model: LinearModel, index: int, background: list[float] | None = None) -> str:
    """SQL text of coef * (scaled value - background); the background is the origin unless given."""
    x = model.scaled(index)
    if background is not None:
        x = f"({x} - {background[index]!r}D)"
    return f"{model.coef[index]!r}D * {x}"


def scaled_means(features: DataFrame, model: LinearModel) -> list[float]:
    """Mean of every scaled feature: the background when explaining a data set (one row)."""
    row = features.selectExpr(*[f"AVG({model.scaled(i)}) AS m{i}" for i in range(len(model.features))]).first()
    return list(row)


def _doubles(values: list[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def _values(model: LinearModel) -> str:
    return "array(" + ", ".join(f"CAST({f} AS DOUBLE)" for f in model.features) + ")"


def _phi(model: LinearModel, background: list[float] | None) -> str:
    """SQL text of the attribution of value x at 0-based position i.

    Looking the coefficients up by position keeps the generated code small however many
    features there are; spelled out per feature it outgrows what the JVM compiles.
    """
    x = f"(x - {_doubles(model.mean)}[i]) / {_doubles(model.std)}[i]"
    if background is not None:
        x = f"({x} - {_doubles(background)}[i])"
    return f"{_doubles(model.coef)}[i] * ({x})"


def _feature_names(model: LinearModel) -> str:
    return "array(" + ", ".join(f"'{f}'" for f in model.features) + ")"


def attributions(df: DataFrame, model: LinearModel, background: list[float] | None = None) -> DataFrame:
    """Long form: one row per record and feature."""
    record = (
        f"named_struct('position', i, 'feature', {_feature_names(model)}[i], 'value', x,"
        f" 'phi', {_phi(model, background)})"
    )
    return df.selectExpr("customer_id", f"inline(transform({_values(model)}, (x, i) -> {record}))")


def _names(mapping: dict[str, str], feature: Column) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), feature), F.initcap(F.regexp_replace(feature, "_", " "))
    )


def reason_text(feature: Column, direction: Column, names: dict[str, str] | None = None) -> Column:
    return F.concat(_names(names or ONLINE_NAMES, feature), F.lit(" "), direction, F.lit(" churn risk"))


def top_reasons(
    df: DataFrame,
    model: LinearModel,
    n: int = 3,
    background: list[float] | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Add `top_reasons`: the n features with the largest absolute attribution, no shuffle.

    Structs sort field by field, so ascending order on (-|phi|, -position) puts the
    largest first and, on a tie, the later feature.
    """
    phis = f"transform({_values(model)}, (x, i) -> {_phi(model, background)})"
    ranked = "transform(_phis, (p, i) -> named_struct('rank_key', -abs(p), 'back', -i, 'phi', p))"
    best = computed_once(
        computed_once(df, {"_phis": phis}), {"_best": f"slice(sort_array({ranked}), 1, {n})"}, drop=("_phis",)
    )
    held, features = F.expr(_values(model)), F.expr(_feature_names(model))

    def reason(entry: Column) -> Column:
        place = F.lit(1) - entry["back"]
        feature = F.element_at(features, place)
        direction = F.when(entry["phi"] > 0, "increases").otherwise("decreases")
        return F.struct(
            feature.alias("feature"),
            F.element_at(held, place).alias("value"),
            F.abs(entry["phi"]).alias("impact"),
            direction.alias("direction"),
            entry["phi"].alias("shap_value"),
            reason_text(feature, direction, names).alias("description"),
        )

    return computed_once(best, {"top_reasons": F.transform("_best", reason)}, drop=("_best",))


def top_reason(df: DataFrame, model: LinearModel, background: list[float] | None = None) -> DataFrame:
    """Only the leading feature's name per record; on a tie the earlier feature."""
    ranked = f"transform({_values(model)}, (x, i) -> named_struct('rank_key', -abs({_phi(model, background)}), 'at', i))"
    return df.withColumn("top_reason", F.expr(f"{_feature_names(model)}[array_min({ranked}).at]"))


def reason_rows(with_reasons: DataFrame) -> DataFrame:
    """One row per record and reason, ranked from 1."""
    return with_reasons.select("customer_id", F.posexplode("top_reasons").alias("p", "r")).select(
        "customer_id", (F.col("p") + 1).alias("reason_rank"), "r.*"
    )


def importance(
    df: DataFrame, model: LinearModel, background: list[float] | None = None, top: int | None = None
) -> DataFrame:
    """Mean absolute attribution per feature: one aggregation row, unpivoted afterwards."""
    means = df.selectExpr(
        *[f"AVG(ABS({attribution(model, i, background)})) AS {name}" for i, name in enumerate(model.features)]
    )
    ranked = means.unpivot([], model.features, "feature", "importance").orderBy(
        F.desc("importance"), "feature"
    )
    return ranked if top is None else ranked.limit(top)
