"""Stores whose state becomes visible as a whole: prediction batches and loads of all tables.

Data is written to a folder of its own first; a small marker file, which only one writer can
create, names it last. Readers go by the markers alone, so a job that fails midway, or whose
answer is lost and which runs again, leaves nothing visible and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.schema import Tables
from keepsake.sources.sinks import TABLES
from keepsake.storage import create_once, small_files


def _batches(spark: SparkSession, path: str) -> dict[str, dict]:
    return {name.removesuffix(".json"): json.loads(text) for name, text in small_files(spark, f"{path}/batches").items()}


def append_predictions(predictions: DataFrame, path: str, batch: str, version: str, scored_at: str) -> bool:
    """Add a batch of predictions of one model version; false if the batch is there already."""
    spark = predictions.sparkSession
    if batch in _batches(spark, path):
        return False
    folder = f"data/{batch}-{uuid.uuid4().hex}"
    predictions.sortWithinPartitions("customer_id").write.parquet(f"{path}/{folder}")
    entry = {"folder": folder, "model_version": version, "scored_at": scored_at}
    return create_once(spark, f"{path}/batches/{batch}.json", json.dumps(entry))


def prediction_history(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """All rows of all batches with batch, model_version and scored_at; of a ``version`` only its
    batches' folders are read. None if there is no such batch."""
    parts = None
    for batch, entry in sorted(_batches(spark, path).items()):
        if version is not None and entry["model_version"] != version:
            continue
        rows = spark.read.parquet(f"{path}/{entry['folder']}").drop("batch", "model_version", "scored_at")
        rows = rows.withColumns({
            "batch": F.lit(batch), "model_version": F.lit(entry["model_version"]), "scored_at": F.lit(entry["scored_at"]),
        })
        parts = rows if parts is None else parts.unionByName(rows, allowMissingColumns=True)
    return parts


def latest_predictions(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """Each customer's newest row (by scored_at, then batch), combined before it is shuffled."""
    rows = prediction_history(spark, path, version)
    if rows is None:
        return None
    others = [c for c in rows.columns if c not in ("customer_id", "scored_at", "batch")]
    newest = F.max(F.struct("scored_at", "batch", *others)).alias("newest")
    return rows.groupBy("customer_id").agg(newest).select("customer_id", "newest.*")


def load_snapshot(tables: Tables, path: str, before_switch=None) -> int:
    """Store all tables as one load; readers see it once its number is taken. ``before_switch`` is
    called when all data is written."""
    spark = tables.customers.sparkSession
    folder = f"loads/{uuid.uuid4().hex}"
    for name in TABLES:
        df = getattr(tables, name)
        if "customer_id" in df.columns:
            df = df.sortWithinPartitions("customer_id")
        df.write.parquet(f"{path}/{folder}/{name}")
    if before_switch is not None:
        before_switch()
    number = max(map(int, small_files(spark, f"{path}/current")), default=0) + 1
    while not create_once(spark, f"{path}/current/{number:010d}", folder):
        number += 1
    return number


def snapshot_tables(spark: SparkSession, path: str, number: int | None = None) -> Tables:
    """The tables of the newest load, or of a numbered one."""
    loads = {int(name): folder for name, folder in small_files(spark, f"{path}/current").items()}
    if not loads:
        raise FileNotFoundError(f"no load under {path}")
    folder = loads[max(loads) if number is None else number]
    return Tables(**{name: spark.read.parquet(f"{path}/{folder}/{name}") for name in TABLES})
