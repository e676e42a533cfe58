"""Scoring as a stream: the single-record call and its running summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepsake.functions.bands import first_match
from keepsake.operators.explain import top_reasons
from keepsake.operators.features import ADD_ONS
from keepsake.operators.scoring import LinearModel, score_requests
from keepsake.schema import REQUEST_SCHEMA, RISK_LEVELS, literal_rows
from keepsake.sources.raw import clean


def request_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Requests arriving as files in a folder."""
    return spark.readStream.schema(REQUEST_SCHEMA).format(fmt).load(path)


def raw_to_requests(raw: DataFrame) -> DataFrame:
    """Raw extract rows to scoring requests; row-wise, so it works on streams too."""
    cleaned = clean(raw)
    sources = {
        "online_security": "onlinesecurity", "online_backup": "onlinebackup",
        "device_protection": "deviceprotection", "tech_support": "techsupport",
        "streaming_tv": "streamingtv", "streaming_movies": "streamingmovies",
    }
    return cleaned.select(
        F.col("customerid").alias("customer_id"),
        "gender",
        F.col("seniorcitizen").alias("senior_citizen"),
        "partner",
        "dependents",
        F.col("tenure").alias("tenure_months"),
        F.col("monthlycharges").alias("monthly_charges"),
        F.col("totalcharges").alias("total_charges"),
        F.col("contract").alias("contract_type"),
        F.col("paymentmethod").alias("payment_method"),
        F.col("paperlessbilling").alias("paperless_billing"),
        F.col("phoneservice").alias("phone_service"),
        (F.col("multiplelines") == "Yes").alias("multiple_lines"),
        first_match(
            [(F.col("internetservice").isin("DSL", "Fiber optic"), F.col("internetservice")), (None, "No")]
        ).alias("internet_service"),
        *[(F.col(sources[c]) == "Yes").alias(c) for c in ADD_ONS],
    )


def respond(requests: DataFrame, model: LinearModel, reasons: int = 3) -> DataFrame:
    """Responses: probability, prediction, level and ranked reasons. Stateless, so no watermark."""
    scored = top_reasons(score_requests(requests, model), model, reasons)
    return scored.select(
        "customer_id",
        "churn_prediction",
        F.round("probability", 4).alias("churn_probability"),
        "risk_level",
        F.transform(
            "top_reasons",
            lambda r: F.struct(
                r["feature"].alias("feature"), r["impact"].alias("impact"),
                r["direction"].alias("direction"), r["description"].alias("description"),
            ),
        ).alias("top_reasons"),
    )


def start_scoring(
    requests: DataFrame, model: LinearModel, out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append responses to a Parquet folder; the file sink commits each batch exactly once."""
    writer = (
        respond(requests, model)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_summary(
    requests: DataFrame, model: LinearModel, out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Running count per risk level; the state is four rows.

    Each batch writes the complete table under its own batch number, so a repeated
    batch replaces its own folder and readers take the newest one. Older folders than
    the one before go, so the store stays constant however long the stream runs.
    """
    counts = score_requests(requests, model).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={number - 2}")
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

    writer = (
        counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_summary(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete counts, all four levels present."""
    saved = spark.read.schema("risk_level string, n long, batch long").parquet(out)
    newest = saved.groupBy("risk_level").agg(F.max_by("n", "batch").alias("n"))
    levels = literal_rows(spark, [(r,) for r in RISK_LEVELS], ["risk_level"])
    return levels.join(newest, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))
