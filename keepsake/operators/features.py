"""The 61 model features as column expressions.

Three modes share one set of rules and differ in the four that need reference values:

* ``fit``     values come from the data at hand (training);
* ``serve``   fixed constants, for records scored without a data set;
* ``fitted``  the training data's values applied to new records.

Everything is built in a few wide selects; only `FeatureStats.fit` reads data.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import ranking
from keepsake.schema import FEATURES

# Constants of the serve mode.
SERVE_HIGH_VALUE = 70
SERVE_CHARGE_STEP = 25
SERVE_TENURE_STEP = 18
SERVE_HIGH_CHARGE = 15
# Weight of each risk factor in the risk score.
RISK_WEIGHTS = {
    "risk_mtm": 3, "risk_new": 2, "risk_echeck": 2,
    "risk_no_support": 1, "risk_high_charge": 1, "risk_fiber": 1,
}
# Rows per contract name and payment flag per method.
CONTRACT_LENGTHS = {"Month-to-month": 0, "One year": 1, "Two year": 2}
PAYMENT_FLAGS = {
    "payment_electronic_check": "Electronic check",
    "payment_mailed_check": "Mailed check",
    "payment_bank_transfer": "Bank transfer (automatic)",
    "payment_credit_card": "Credit card (automatic)",
}
ADD_ONS = [
    "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies",
]

MODES = ("fit", "serve", "fitted")

# Names the feature layers produce besides the 61 that a model takes.
EXTRA_FEATURES = ["family_size_proxy"]


def _int(condition: str) -> str:
    return f"CAST(COALESCE({condition}, FALSE) AS INT)"


def _add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()])


def computed_once(df: DataFrame, columns: dict[str, str | Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns as one generated record.

    The optimizer copies a column's expression into every later use and filter. For
    expressions that build on each other over several layers the copies multiply until
    planning takes longer than the query. A one-record `inline` is evaluated once per row,
    stays in generated code, and later expressions and filters just refer to its output.
    """
    fields = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    kept = [c for c in df.columns if c not in columns and c not in drop]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))


def profile_to_request(base: DataFrame) -> DataFrame:
    """Stored profile to scoring request: one internet field (fiber wins), plain doubles.

    A missing total is repaired as on loading: monthly charges times tenure, or 0.
    """
    return base.selectExpr(
        "customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure_months",
        "CAST(monthly_charges AS DOUBLE) AS monthly_charges",
        "COALESCE(CAST(total_charges AS DOUBLE), CAST(monthly_charges AS DOUBLE) * tenure_months, 0D) AS total_charges",
        "contract_type", "payment_method",
        "COALESCE(paperless_billing, FALSE) AS paperless_billing",
        "has_phone_service AS phone_service",
        "has_multiple_lines AS multiple_lines",
        "CASE WHEN has_fiber THEN 'Fiber optic' WHEN has_dsl THEN 'DSL' ELSE 'No' END AS internet_service",
        *[f"has_{c} AS {c}" for c in ADD_ONS],
    )


def _entry(df: DataFrame, keep: list[str]) -> DataFrame:
    """Common starting columns, from a stored profile (has_* flags) or from a request."""
    stored = "has_fiber" in df.columns
    if stored:
        fiber, dsl, online = "has_fiber", "has_dsl", "has_fiber OR has_dsl"
    else:
        fiber, dsl = "internet_service = 'Fiber optic'", "internet_service = 'DSL'"
        online = "internet_service <> 'No'"
    columns = {
        "tenure_months": "tenure_months",
        "monthly_charges": "CAST(monthly_charges AS DOUBLE)",
        "total_charges": "CAST(total_charges AS DOUBLE)",
        "_contract": "COALESCE(contract_type, '')",
        "_payment": "COALESCE(payment_method, '')",
        "gender_male": _int("gender = 'Male'"),
        "is_senior": _int("senior_citizen"),
        "has_partner": _int("partner"),
        "has_dependents": _int("dependents"),
        **{
            f"{s}_flag": _int(f"has_{s}" if stored else s)
            for s in ["phone_service", "multiple_lines", *ADD_ONS]
        },
        "has_internet": _int(online),
        "internet_fiber": _int(fiber),
        "internet_dsl": _int(dsl),
        "paperless_billing_flag": _int("paperless_billing"),
    }
    return df.selectExpr("customer_id", *keep, *[f"{text} AS {name}" for name, text in columns.items()])


def _profile_features(df: DataFrame) -> DataFrame:
    """Demographic, service, contract and tenure features."""
    lengths = " ".join(f"WHEN _contract = '{name}' THEN {n}" for name, n in CONTRACT_LENGTHS.items())
    bounds = " ".join(f"WHEN tenure_months <= {b} THEN {i}" for i, b in enumerate((6, 12, 24, 48, 72), start=1))
    add_on_flags = [f"{s}_flag" for s in ADD_ONS]
    return _add(
        df,
        {
            "has_family": "GREATEST(has_partner, has_dependents)",
            "family_size_proxy": "has_partner + has_dependents",
            "senior_alone": "is_senior * (1 - GREATEST(has_partner, has_dependents))",
            "total_services": " + ".join(["phone_service_flag", "multiple_lines_flag", *add_on_flags, "has_internet"]),
            "premium_service_count": " + ".join(add_on_flags),
            "has_security_bundle": "GREATEST(online_security_flag, online_backup_flag)",
            "has_support_bundle": "GREATEST(tech_support_flag, device_protection_flag)",
            "has_streaming_bundle": "GREATEST(streaming_tv_flag, streaming_movies_flag)",
            "contract_length": f"CASE {lengths} ELSE 0 END",
            "is_month_to_month": _int("_contract = 'Month-to-month'"),
            "has_long_contract": _int("_contract IN ('One year', 'Two year')"),
            **{flag: _int(f"_payment = '{method}'") for flag, method in PAYMENT_FLAGS.items()},
            "has_auto_payment": _int("_payment IN ('Bank transfer (automatic)', 'Credit card (automatic)')"),
            "tenure_years": "tenure_months / 12D",
            "tenure_bucket": f"CASE {bounds} ELSE 6 END",
            "is_new_customer": _int("tenure_months <= 6"),
            "is_established": _int("tenure_months >= 24"),
            "is_loyal": _int("tenure_months >= 48"),
        },
    )


def _spend_features(df: DataFrame) -> DataFrame:
    return _add(
        df,
        {
            "service_diversity": "total_services / 9D",
            "avg_monthly_spend": (
                "CASE WHEN tenure_months > 0 THEN TRY_DIVIDE(total_charges, tenure_months) ELSE monthly_charges END"
            ),
            "charge_per_service": (
                "CASE WHEN total_services > 0 THEN TRY_DIVIDE(monthly_charges, total_services) ELSE monthly_charges END"
            ),
            "estimated_clv": "total_charges + monthly_charges * 12",
            "tenure_contract_interaction": "tenure_months * contract_length",
        },
    )


@dataclass(frozen=True)
class FeatureStats:
    """What the fit and fitted modes need to know about the training data."""

    median_monthly: float | None
    monthly_edges: list[float | None]
    median_charge_per_service: float | None
    tenure_cuts: list[tuple[float | None, str | None]] = field(default_factory=list)

    @classmethod
    def fit(cls, base: DataFrame) -> FeatureStats:
        """Exact medians, quartile edges and tenure cut rows; a handful of numbers leaves the cluster."""
        narrow = _spend_features(_profile_features(_entry(base, []))).select(
            "customer_id", "monthly_charges", "charge_per_service", "tenure_months"
        )
        cuts, spread = ranking.look_up(
            narrow,
            {
                "monthly": F.col("monthly_charges"),
                "per_service": F.col("charge_per_service"),
                "tenure": F.col("tenure_months").cast("double"),
            },
            cuts={"tenure": ranking.first_rank_places(4)},
            quantiles={"monthly": [0.25, 0.5, 0.75], "per_service": [0.5]},
            tie="customer_id",
        )
        return cls(
            median_monthly=spread["monthly"][1],
            monthly_edges=spread["monthly"],
            median_charge_per_service=spread["per_service"][0],
            tenure_cuts=cuts["tenure"],
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(json.dumps(asdict(self)),)], "stats string")

    @classmethod
    def from_frame(cls, frame: DataFrame) -> FeatureStats:
        values = json.loads(frame.first()["stats"])
        values["tenure_cuts"] = [tuple(c) for c in values["tenure_cuts"]]
        return cls(**values)


def _above(name: str, median: float | None, times: float = 1.0) -> Column:
    """1 above the median; 0 where the training data had no value to take one of."""
    if median is None:
        return F.lit(0)
    return F.coalesce(F.col(name) > F.lit(median * times), F.lit(False)).cast("int")


def _reference_features(df: DataFrame, stats: FeatureStats | None) -> DataFrame:
    """The four features that compare a record with the data set (or with constants)."""
    if stats is None:
        own = {
            "monthly_charge_quartile": F.expr(
                f"CAST(LEAST(GREATEST(FLOOR(monthly_charges / {SERVE_CHARGE_STEP}) + 1, 1), 4) AS INT)"
            ),
            "tenure_quartile": F.expr(
                f"CAST(LEAST(GREATEST(FLOOR(tenure_months / {SERVE_TENURE_STEP}) + 1, 1), 4) AS INT)"
            ),
            "is_high_value": F.expr(_int(f"monthly_charges > {SERVE_HIGH_VALUE}")),
            "risk_high_charge": F.expr(_int(f"charge_per_service > {SERVE_HIGH_CHARGE}")),
        }
    else:
        own = {
            "monthly_charge_quartile": ranking.value_tile(F.col("monthly_charges"), stats.monthly_edges),
            "tenure_quartile": ranking.tile_column(
                F.col("tenure_months"), F.col("customer_id"), stats.tenure_cuts
            ),
            "is_high_value": _above("monthly_charges", stats.median_monthly),
            "risk_high_charge": _above("charge_per_service", stats.median_charge_per_service, 1.5),
        }
    return _add(
        df.select("*", *[column.alias(name) for name, column in own.items()]),
        {
            "spending_trend": (
                "CASE WHEN avg_monthly_spend > monthly_charges THEN 1"
                " WHEN avg_monthly_spend < monthly_charges THEN -1 ELSE 0 END"
            ),
            "risk_mtm": "is_month_to_month",
            "risk_new": "is_new_customer",
            "risk_echeck": "payment_electronic_check",
            "risk_no_support": "(1 - has_security_bundle) * (1 - has_support_bundle)",
            "risk_fiber": "internet_fiber",
        },
    )


def _risk_features(df: DataFrame) -> DataFrame:
    score = " + ".join(f"{weight} * {factor}" for factor, weight in RISK_WEIGHTS.items())
    return _add(
        df,
        {
            "risk_factors_count": " + ".join(RISK_WEIGHTS),
            "risk_score": score,
            "high_risk_flag": _int(f"{score} >= 5"),
            "new_high_value": "is_new_customer * is_high_value",
            "mtm_high_value": "is_month_to_month * is_high_value",
            "senior_mtm": "is_senior * is_month_to_month",
            "fiber_no_support": "internet_fiber * (1 - has_support_bundle)",
        },
    )


def with_features(
    df: DataFrame, mode: str, stats: FeatureStats | None = None, keep: tuple[str, ...] = (),
    names: list[str] | None = None,
) -> DataFrame:
    """Add features to a stored profile or a request; `keep` names input columns to carry along.

    All features by default; of `names` only these are computed and only their inputs read.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "fitted" and stats is None:
        raise ValueError("fitted mode needs the training data's stats")
    if mode == "serve":
        stats = None
    elif mode == "fit" and stats is None:
        stats = FeatureStats.fit(df)
    names = FEATURES + EXTRA_FEATURES if names is None else list(names)
    carried = [c for c in keep if c not in names and c != "customer_id"]
    built = _risk_features(_reference_features(_spend_features(_profile_features(_entry(df, carried))), stats))
    return computed_once(built.select("customer_id", *carried, *names), {n: n for n in names})


def select_features(
    df: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, list[str]]:
    """Model columns in model order, nulls as 0; names that do not exist are reported back."""
    names = names or FEATURES
    found = [n for n in names if n in df.columns]
    missing = [n for n in names if n not in df.columns]
    extra = [c for c in keep if c not in found]
    return df.selectExpr("customer_id", *extra, *[f"COALESCE({n}, 0) AS {n}" for n in found]), missing


def training_frame(base: DataFrame, stats: FeatureStats | None = None, mode: str = "fit") -> DataFrame:
    """Ids, label and the 61 features."""
    built = with_features(base, mode, stats, keep=("churn",))
    selected, missing = select_features(built, keep=("churn",))
    if missing:
        raise ValueError(f"features not available: {missing}")
    return selected.withColumn("churn", F.col("churn").cast("int"))


def class_balance(frame: DataFrame) -> DataFrame:
    """Rows and share per label."""
    counts = frame.groupBy("churn").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.collect_list(F.struct("churn", "n")).alias("labels"), F.sum("n").alias("total"))
    return totals.select(F.explode("labels").alias("l"), "total").select(
        F.col("l.churn").alias("churn"),
        F.col("l.n").alias("n"),
        F.round(F.lit(100) * F.col("l.n").cast("decimal(18,0)") / F.col("total").cast("decimal(18,0)"), 1).alias(
            "share_pct"
        ),
    )
