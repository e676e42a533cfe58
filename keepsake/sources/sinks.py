"""Writers and their readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators.features import FeatureStats
from keepsake.operators.scoring import LinearModel
from keepsake.schema import FEATURES, Tables, literal_rows

TABLES = ["customers", "customer_contracts", "customer_services", "contract_types", "service_types"]


def load_tables(tables: Tables, path: str) -> None:
    """Replace the stored tables. Customer tables are sorted by id inside each file, so id filters skip row groups."""
    for name in TABLES:
        df = getattr(tables, name)
        if "customer_id" in df.columns:
            df = df.sortWithinPartitions("customer_id")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def stored_tables(spark: SparkSession, path: str) -> Tables:
    return Tables(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})


def load_bucketed(tables: Tables, database: str, buckets: int) -> None:
    """Store the customer tables bucketed by id, so that their joins and groupings need no shuffle."""
    for name in TABLES:
        df = getattr(tables, name)
        writer = df.write.mode("overwrite").format("parquet")
        if "customer_id" in df.columns:
            writer = (
                df.repartition(buckets, "customer_id")
                .write.mode("overwrite")
                .format("parquet")
                .bucketBy(buckets, "customer_id")
                .sortBy("customer_id")
            )
        writer.saveAsTable(f"{database}.{name}")


def bucketed_tables(spark: SparkSession, database: str) -> Tables:
    return Tables(**{name: spark.table(f"{database}.{name}") for name in TABLES})


def write_features(frame: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The feature columns, then label and id."""
    ordered = frame.select(*FEATURES, "churn", "customer_id")
    writer = ordered.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").partitionBy("risk_level").parquet(path)


def export_risk_list(listed: DataFrame, path: str) -> None:
    listed.write.mode("overwrite").option("header", True).csv(path)


def write_artifacts(
    path: str,
    spark: SparkSession,
    model_name: str,
    trained_at: str,
    features: Sequence[str],
    measured: dict[str, float],
    n_train: int,
    n_test: int,
    importance: DataFrame | None = None,
    linear: LinearModel | None = None,
    stats: FeatureStats | None = None,
) -> None:
    """Metadata, feature names, importance and (for a linear model) its coefficients as small tables."""
    spark.createDataFrame(
        [(model_name, trained_at, len(features), n_train, n_test, measured)],
        "model_name string, training_date string, n_features long, n_training_samples long,"
        " n_test_samples long, test_metrics map<string,double>",
    ).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    literal_rows(spark, list(enumerate(features)), ["position", "feature"]).coalesce(1).write.mode("overwrite").json(f"{path}/feature_names")
    if importance is not None:
        importance.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/feature_importance")
    if linear is not None:
        linear.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/linear_model")
    if stats is not None:
        stats.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/feature_stats")


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """Name, date, sizes and metrics of a stored model, one row per metric."""
    shape = (
        "model_name string, training_date string, n_features long, n_training_samples long,"
        " n_test_samples long, test_metrics map<string,double>"
    )
    return (
        spark.read.schema(shape)
        .json(f"{path}/metadata")
        .select(
            "model_name", "training_date", "n_features", "n_training_samples", "n_test_samples",
            F.explode("test_metrics").alias("metric", "value"),
        )
    )


def stored_importance(spark: SparkSession, path: str, top: int | None = 20) -> DataFrame:
    listed = (
        spark.read.schema("feature string, importance double")
        .option("header", True)
        .csv(f"{path}/feature_importance")
        .orderBy(F.desc("importance"), "feature")
    )
    return listed if top is None else listed.limit(top)


def stored_linear_model(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel.from_frame(spark.read.parquet(f"{path}/linear_model"))


def stored_stats(spark: SparkSession, path: str) -> FeatureStats:
    return FeatureStats.from_frame(spark.read.parquet(f"{path}/feature_stats"))


def query_table(spark: SparkSession, text: str, params: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Run a parameterised query; frames are named in the text as {name}, values as :name."""
    return spark.sql(text, args=params or {}, **frames)
