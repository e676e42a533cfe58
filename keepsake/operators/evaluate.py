"""Exact classification metrics from per-score counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions.metrics import count_if, sum_if
from keepsake.functions.ranking import running_totals
from keepsake.schema import METRIC_TARGETS, literal_rows
from keepsake.storage import cut_lineage


def _label_counts(df: DataFrame, label: str, keys: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(
        count_if(F.col(label) == 1).alias("pos"), count_if(F.col(label) == 0).alias("neg")
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    return _label_counts(df, label, [F.col(score).cast("double").alias("score")])


def _ranked(counts: DataFrame) -> DataFrame:
    """Running sums from the highest score down."""
    return running_totals(counts, [F.desc("score")], ["pos", "neg"])


def _ratio(part, total):
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "churn", prediction: str = "churn_prediction") -> DataFrame:
    """All four cells, empty ones included."""
    cells = {
        (a, p): count_if((F.col(label) == a) & (F.col(prediction) == p)) for a in (0, 1) for p in (0, 1)
    }
    counted = df.agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), n.alias("n"))
                for (a, p), n in cells.items()
            ]
        ).alias("cells")
    )
    return counted.select(F.explode("cells").alias("c")).select("c.*")


def _class_metrics(counts: DataFrame) -> DataFrame:
    hit = F.col("prediction") == 1
    cells = counts.groupBy("model").agg(
        sum_if(hit, F.col("pos")).alias("tp"),
        sum_if(hit, F.col("neg")).alias("fp"),
        sum_if(~hit, F.col("pos")).alias("fn"),
        sum_if(~hit, F.col("neg")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "model",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _rank_metrics(counts: DataFrame) -> DataFrame:
    """ROC-AUC (rank sum, ties shared) and average precision (step sum), without binning."""
    by_score = counts.groupBy("model", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ran = running_totals(by_score, ["model", F.desc("score")], ["pos", "neg"])
    # the sums run over all models: take off what stands before a model's first row (a row per model)
    starts = ran.groupBy("model").agg(F.min("pos_before").alias("_pos"), F.min("neg_before").alias("_neg"))
    ranked = ran.join(starts, "model").withColumns(
        {f"{c}_{at}": F.col(f"{c}_{at}") - F.col(f"_{c}") for c in ("pos", "neg") for at in ("before", "through")}
    )
    beaten = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0))
    precision = F.col("pos_through") / (F.col("pos_through") + F.col("neg_through"))
    return ranked.groupBy("model").agg(
        F.try_divide(beaten, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("avg_precision"),
    )


def metrics(
    df: DataFrame, label: str = "churn", prediction: str = "churn_prediction", score: str = "probability"
) -> DataFrame:
    """The six test metrics in long form, from one pass: label counts per score and prediction."""
    return model_metrics(df.withColumn("model", F.lit("")), label, prediction, score).drop("model")


def model_metrics(
    df: DataFrame, label: str = "churn", prediction: str = "churn_prediction", score: str = "probability"
) -> DataFrame:
    """`metrics` for each value of `model`, all counted in one pass over the stacked rows."""
    keys = [F.col("model"), F.col(score).cast("double").alias("score"), F.col(prediction).alias("prediction")]
    counts = cut_lineage(_label_counts(df, label, keys))
    out = None
    for part in (_class_metrics(counts), _rank_metrics(counts)):
        names = [c for c in part.columns if c != "model"]
        long = part.unpivot(["model"], names, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def roc_points(df: DataFrame, label: str = "churn", score: str = "probability") -> DataFrame:
    """One point per distinct score, plus the origin (null threshold)."""
    counts = _ranked(_by_score(df, label, score))
    all_pos, all_neg = counts.agg(F.sum("pos"), F.sum("neg")).first()
    points = counts.select(
        F.col("score").alias("threshold"),
        _ratio(F.col("neg_through"), F.lit(all_neg)).alias("fpr"),
        _ratio(F.col("pos_through"), F.lit(all_pos)).alias("tpr"),
    )
    origin = counts.agg(
        F.max(F.lit(None).cast("double")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def check_targets(measured: DataFrame) -> DataFrame:
    """Measured metrics against their targets."""
    targets = literal_rows(measured.sparkSession, list(METRIC_TARGETS.items()), ["metric", "target"])
    return targets.join(measured, "metric", "left").select(
        "metric", F.col("value").alias("actual"), "target",
        F.coalesce(F.col("value") >= F.col("target"), F.lit(False)).alias("met"),
    )


def compare_models(measured: DataFrame) -> DataFrame:
    """One row per model with its metrics, best ROC-AUC first; the earlier trained wins a tie.

    `measured` holds (model_order, model, metric, value).
    """
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision"]
    table = measured.groupBy("model_order", "model").agg(
        *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names]
    )
    best_first = W.orderBy(F.desc("roc_auc"), "model_order")  # a handful of models
    return table.select(
        "model", *names, (F.row_number().over(best_first) == 1).alias("is_best")
    ).orderBy(F.desc("is_best"), F.desc("roc_auc"))
