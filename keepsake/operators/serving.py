"""Scoring and explaining with any fitted classifier, as trained or as reloaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions.bands import model_risk_level
from keepsake.operators import trees
from keepsake.operators.explain import reason_text
from keepsake.operators.splits import Scaler


@dataclass(frozen=True)
class FittedModel:
    """A fitted MLlib classifier with the scaler of its training rows."""

    name: str
    model: object
    scaler: Scaler


def save_model(fitted: FittedModel, path: str) -> None:
    fitted.model.write().overwrite().save(f"{path}/best")


def load_model(spark: SparkSession, path: str, name: str, scaler: Scaler) -> FittedModel:
    """The stored classifier, of whatever kind it is."""
    return FittedModel(name, DefaultParamsReader.loadParamsInstance(f"{path}/best", spark), scaler)


def score(features: DataFrame, fitted: FittedModel) -> DataFrame:
    """Add the probability, the 0/1 prediction and the risk level, as `scoring.score` does."""
    scaled = [
        f"(({c} - {m!r}D) / {s!r}D) AS `_{c}`"
        for c, m, s in zip(fitted.scaler.features, fitted.scaler.mean, fitted.scaler.std)
    ]
    held = features.selectExpr("*", *scaled)
    built = VectorAssembler(inputCols=[f"_{c}" for c in fitted.scaler.features], outputCol="features").transform(held)
    kept = [F.col(c) for c in features.columns]
    scored = fitted.model.transform(built).select(*kept, vector_to_array("probability")[1].alias("probability"))
    return scored.select(
        "*", (F.col("probability") >= 0.5).cast("int").alias("churn_prediction"),
        model_risk_level(F.col("probability")).alias("risk_level"),
    )


def output(model, scaled: DataFrame, features: list[str]) -> DataFrame:
    """customer_id and what the attributions of a tree model add up to, less its base value:
    the probability of a forest, the margin of boosted trees."""
    raw = model.__class__.__name__.startswith("GBT")
    base = Vectors.dense([0.0] * len(features))
    built = VectorAssembler(inputCols=features, outputCol="features").transform(scaled)
    # boosting's raw value is twice the sum of its trees
    value = vector_to_array("rawPrediction")[1] if raw else vector_to_array("probability")[1]
    start = model.predictRaw(base)[1] if raw else model.predictProbability(base)[1]
    return model.transform(built).select("customer_id", (value - F.lit(float(start))).alias("output"))


def tree_reasons(scaled: DataFrame, model, features: list[str], n: int = 3) -> DataFrame:
    """The n features with the largest absolute attribution per record, as rows ranked from 1.

    A record has one row per feature before the choice, so its window is bounded.
    """
    return ranked_reasons(trees.tree_attributions(scaled, model, features), n)


def ranked_reasons(long: DataFrame, n: int = 3) -> DataFrame:
    """The reasons of records from attributions in long form."""
    order = W.partitionBy("customer_id").orderBy(F.desc(F.abs("phi")), F.desc("position"))
    best = long.withColumn("reason_rank", F.row_number().over(order)).filter(F.col("reason_rank") <= n)
    direction = F.when(F.col("phi") > 0, "increases").otherwise("decreases")
    return best.select(
        "customer_id", "reason_rank", "feature", F.abs("phi").alias("impact"), direction.alias("direction"),
        F.col("phi").alias("shap_value"), reason_text(F.col("feature"), direction).alias("description"),
    )
