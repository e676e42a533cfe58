"""Stratified splits, folds, scaling and class weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import ranking
from keepsake.schema import literal_rows
from keepsake.sources.raw import hash_order


def _label_cuts(frame: DataFrame, label: str, seed: int, places) -> dict[int, list[ranking.Cut]]:
    """Cut rows of a seeded shuffle inside each of the two classes, in one look-up."""
    found = ranking.cut_points_by(
        frame.select("customer_id", F.col(label).cast("int").alias("label")), F.col("label"),
        hash_order("customer_id", seed), "customer_id", {"0": places, "1": places},
    )
    return {y: found[str(y)] for y in (0, 1)}


def _tile(label: str, seed: int, cuts: dict[int, list[ranking.Cut]]) -> Column:
    order, tie = hash_order("customer_id", seed), F.col("customer_id")
    zero, one = (ranking.tile_column(order, tie, cuts[y]) for y in (0, 1))
    return F.when(F.col(label) == 1, one).otherwise(zero)


def stratified_split(
    frame: DataFrame, label: str = "churn", test_share: float = 0.2, seed: int = 42, labels: DataFrame | None = None
) -> DataFrame:
    """Add `part`: within each class the first rows of the seeded shuffle are the test part.

    Membership is one comparison with a cut row, so the frame is not moved, and rereading
    it after a failure gives the same parts. `labels` may name a narrower source of the same
    ids and labels, to look the cuts up without building the frame.
    """
    cuts = _label_cuts(frame if labels is None else labels, label, seed, lambda n: [int(test_share * n + 0.5)])
    return frame.withColumn("part", F.when(_tile(label, seed, cuts) == 1, "test").otherwise("train"))


def stratified_folds(frame: DataFrame, label: str = "churn", folds: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` 1..folds with class sizes even to one row."""
    cuts = _label_cuts(frame, label, seed, ranking.ntile_places(folds))
    return frame.withColumn("fold", _tile(label, seed, cuts))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature keeps its scale."""

    features: list[str]
    mean: list[float]
    std: list[float]

    @classmethod
    def fit(cls, frame: DataFrame, features: list[str]) -> Scaler:
        row = frame.selectExpr(
            *[f"AVG({c}) AS {c}_m" for c in features], *[f"STDDEV_POP({c}) AS {c}_s" for c in features]
        ).first()
        n = len(features)
        return cls(features, list(row[:n]), [s if s else 1.0 for s in row[n:]])

    def transform(self, frame: DataFrame) -> DataFrame:
        kept = [c for c in frame.columns if c not in self.features]
        scaled = [
            f"({c} - {m!r}D) / {s!r}D AS {c}" for c, m, s in zip(self.features, self.mean, self.std)
        ]
        return frame.selectExpr(*kept, *scaled)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return literal_rows(
            spark, list(zip(self.features, self.mean, self.std)), ["feature", "mean", "std"]
        )


def class_weights(frame: DataFrame, label: str = "churn") -> DataFrame:
    """Balanced weight per class, and the negative/positive ratio used by boosting."""
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.collect_list(F.struct(label, "n")).alias("labels"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("neg"),
        F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("pos"),
    )
    return totals.select(F.explode("labels").alias("l"), "total", "neg", "pos").select(
        F.col(f"l.{label}").alias(label),
        F.col("l.n").alias("n"),
        F.try_divide(F.col("total").cast("double"), 2.0 * F.col("l.n")).alias("weight"),
        F.try_divide(F.col("neg").cast("double"), F.col("pos")).alias("scale_pos_weight"),
    )
