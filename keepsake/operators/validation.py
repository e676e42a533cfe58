"""Cross-validation of several learners in shared passes over all folds.

Every fold's rows are prepared once (feature statistics, scaler and oversampling from its own
training rows, the folds side by side) and stacked with the fold as the model's number. The
learners then train all folds at once, and one counting of scores measures them all.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators import evaluate
from keepsake.operators.features import FeatureStats, training_frame
from keepsake.operators.histogram_trees import Boosting, Forest, Newton, Training, predict
from keepsake.operators.resampling import smote
from keepsake.operators.splits import Scaler, stratified_folds
from keepsake.schema import FEATURES
from keepsake.storage import stored

SEED = 42
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")

#: The learners with the settings they are trained with.
LEARNERS: dict[str, Boosting | Forest | Newton] = {
    "LogisticRegression": Newton(),
    "RandomForest": Forest(),
    "GradientBoosting": Boosting(),
}


def _columns(frame: DataFrame, fold: int) -> DataFrame:
    return frame.select(F.lit(fold).alias("model"), "customer_id", F.col("churn").cast("int").alias("churn"), *FEATURES)


def fold_rows(base: DataFrame, folds: int = 5, resample: bool = True, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows of all folds: model (the fold), customer_id, churn, features."""
    folded = stored(stratified_folds(base.withColumn("churn", F.col("churn").cast("int")), folds=folds, seed=seed))

    def prepare(fold: int) -> tuple[DataFrame, DataFrame]:
        kept = folded.filter(F.col("fold") != fold).drop("fold")
        held = folded.filter(F.col("fold") == fold).drop("fold")
        stats = FeatureStats.fit(kept)
        train, test = (training_frame(part, stats, "fitted") for part in (kept, held))
        train = stored(train)
        scaler = Scaler.fit(train, FEATURES)
        scaled = scaler.transform(train)
        balanced = smote(scaled, FEATURES, seed=seed) if resample else scaled
        return stored(_columns(balanced, fold)), _columns(scaler.transform(test), fold)

    with ThreadPoolExecutor(folds) as pool:  # the folds' jobs share the cluster
        parts = list(pool.map(prepare, range(1, folds + 1)))
    train, held = (reduce(DataFrame.unionByName, side) for side in zip(*parts))
    return train, held


def fold_scores(
    base: DataFrame, learners: dict[str, Boosting | Forest | Newton] | None = None, folds: int = 5, resample: bool = True,
    seed: int = SEED, block_rows: int | None = None,
) -> DataFrame:
    """model, fold, customer_id, churn, probability and churn_prediction of every held-out row."""
    learners = learners or LEARNERS
    train, held = fold_rows(base, folds, resample, seed)
    training = Training(train, FEATURES, block_rows)
    held = stored(held)
    with ThreadPoolExecutor(len(learners)) as pool:
        grown = list(pool.map(training.grow, learners.values()))
    training.release()
    parts = [
        predict(held, FEATURES, models, p).withColumnRenamed("model", "fold").withColumn("model", F.lit(name))
        for (name, p), models in zip(learners.items(), grown)
    ]
    return stored(reduce(DataFrame.unionByName, parts))


def fold_metrics(scores: DataFrame) -> DataFrame:
    """model, fold, metric, value, from one counting of all models and folds."""
    stacked = scores.withColumn("model", F.concat_ws("/", "model", "fold"))
    named = F.split("model", "/")
    return evaluate.model_metrics(stacked).select(
        named[0].alias("model"), named[1].cast("int").alias("fold"), "metric", "value"
    ).filter(F.col("metric").isin(*METRICS))


def summary(measured: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds; a metric a fold cannot give counts as 0."""
    value = F.coalesce("value", F.lit(0.0))
    return measured.groupBy("model", "metric").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def cross_validate(base: DataFrame, learners: dict[str, Boosting | Forest | Newton] | None = None, folds: int = 5, **settings) -> DataFrame:
    """model, metric, mean and std of all learners: fifteen rows for the three of LEARNERS."""
    return summary(fold_metrics(fold_scores(base, learners, folds, **settings)))
