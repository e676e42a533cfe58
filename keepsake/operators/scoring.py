"""Linear scoring as one column expression, risk levels and batch summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.bands import model_risk_level, table_risk_level
from keepsake.operators.features import computed_once, profile_to_request, select_features, with_features
from keepsake.operators.views import at_risk_profile, customer_by_id, feature_base
from keepsake.schema import RISK_LEVELS, Tables, literal_rows
from keepsake.sources.quality import valid_requests


@dataclass(frozen=True)
class LinearModel:
    """A scaler and a logistic regression, flat enough to be a table of 61 rows."""

    name: str
    features: list[str]
    mean: list[float]
    std: list[float]
    coef: list[float]
    intercept: float

    def scaled(self, index: int) -> str:
        """SQL text of one standardised feature."""
        return f"(({self.features[index]} - {self.mean[index]!r}D) / {self.std[index]!r}D)"

    def logit(self) -> str:
        terms = [f"{c!r}D * {self.scaled(i)}" for i, c in enumerate(self.coef)]
        return " + ".join([f"{self.intercept!r}D", *terms])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.name, i, f, m, s, c, self.intercept)
            for i, (f, m, s, c) in enumerate(zip(self.features, self.mean, self.std, self.coef))
        ]
        return literal_rows(
            spark, rows, ["model_name", "position", "feature", "mean", "std", "coef", "intercept"]
        )

    @classmethod
    def from_frame(cls, frame: DataFrame) -> LinearModel:
        rows = frame.orderBy("position").collect()  # one row per feature
        return cls(
            rows[0]["model_name"],
            [r["feature"] for r in rows],
            [r["mean"] for r in rows],
            [r["std"] for r in rows],
            [r["coef"] for r in rows],
            rows[0]["intercept"],
        )


def score(features: DataFrame, model: LinearModel) -> DataFrame:
    """Add the unrounded probability, the 0/1 prediction and the risk level."""
    scored = computed_once(features, {"probability": f"1D / (1D + EXP(-({model.logit()})))"})
    return scored.select(
        "*",
        (F.col("probability") >= 0.5).cast("int").alias("churn_prediction"),
        model_risk_level(F.col("probability")).alias("risk_level"),
    )


def score_requests(requests: DataFrame, model: LinearModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Validate, build serve-mode features and score; stateless, so batch and stream share it."""
    built = with_features(valid_requests(requests), "serve", keep=keep)
    return score(select_features(built, keep=keep)[0], model)


_CARRIED = ("contract_type", "payment_method", "tech_support", "online_security", "internet_service")


def scored_customers(tables: Tables, model: LinearModel) -> DataFrame:
    """Every stored customer with a valid profile, scored with 4-digit probabilities for reports."""
    scored = score_requests(profile_to_request(feature_base(tables)), model, keep=_CARRIED)
    return scored.withColumn("churn_probability", F.round("probability", 4))


def score_customer(tables: Tables, model: LinearModel, customer_id: str) -> DataFrame:
    return score_requests(profile_to_request(customer_by_id(tables, customer_id)), model)


def at_risk_scored(tables: Tables, model: LinearModel, limit: int = 20, threshold: float = 0.5) -> DataFrame:
    """Score the top of the at-risk profile, then keep those at the threshold or above.

    The limit comes first, so fewer rows than `limit` may remain. The row is the profile with
    its probability, level and ranked reasons.
    """
    from keepsake.operators.explain import top_reasons

    profile = ("gender", "senior_citizen", "partner", "dependents")
    top = profile_to_request(at_risk_profile(tables, limit))
    scored = score_requests(top, model, keep=(*profile, "contract_type", "payment_method"))
    return (
        top_reasons(scored.filter(F.col("probability") >= threshold), model)
        .withColumns({"churn_probability": F.round("probability", 4), "churn": F.lit(False)})
        .select(
            "customer_id", *profile, "tenure_months", "monthly_charges", "total_charges", "churn", "contract_type",
            "payment_method", "churn_probability", "risk_level", "top_reasons",
        )
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """Rows per risk level, levels without rows included."""
    levels = literal_rows(scored.sparkSession, [(r,) for r in RISK_LEVELS], ["risk_level"])
    counts = scored.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def to_predictions(scored: DataFrame, model_version: str, as_of: str, factors: Column | None = None) -> DataFrame:
    """Rows of the predictions table."""
    probability = F.col("probability").cast("decimal(5,4)")
    return scored.select(
        "customer_id",
        probability.alias("churn_probability"),
        (F.col("churn_prediction") == 1).alias("churn_prediction"),
        table_risk_level(probability).alias("risk_level"),
        F.lit(model_version).alias("model_version"),
        (F.lit(None) if factors is None else factors).alias("top_factors"),
        F.lit(as_of).cast("timestamp").alias("prediction_date"),
    )
