"""The end-to-end training job: features, models, artifacts, reload and one scored row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators import explain, features, scoring, serving, training, trees
from keepsake.operators.views import feature_base
from keepsake.schema import FEATURES, METRIC_TARGETS, Tables
from keepsake.sources import sinks


def run(
    tables: Tables, out: str, as_of: str, learners: dict | None = None, run_id: str = "run-1", cv_folds: int = 0
) -> DataFrame:
    """Train, store everything under `out`, reload the winner and score the test customers with
    it; `reload_check` holds their number and the largest gap to the model's own probability.

    Returns the best model's four targeted metrics; `evaluate.check_targets` judges them.
    """
    spark = tables.customers.sparkSession
    base = feature_base(tables)
    stats = features.FeatureStats.fit(base)
    frame = features.training_frame(base, stats)
    sinks.write_features(frame, f"{out}/features", "csv")
    stats.to_frame(spark).write.mode("overwrite").parquet(f"{out}/model/feature_stats")

    trained = training.train_models(base, learners, stats=stats, cv_folds=cv_folds)
    best, prepared = trained.best, trained.prepared
    training.log_runs(trained, f"{out}/runs", spark, run_id, as_of)
    serving.save_model(serving.FittedModel(best, trained.models[best], prepared.scaler), f"{out}/model")
    linear = None
    if best == "LogisticRegression":
        linear = training.to_linear(trained.models[best], prepared.scaler)
        # test rows are already scaled: explain them with the bare coefficients
        bare = scoring.LinearModel(best, FEATURES, [0.0] * len(FEATURES), [1.0] * len(FEATURES), linear.coef, 0.0)
        importance = explain.importance(prepared.test, bare, explain.scaled_means(prepared.test, bare))
    else:
        importance = trees.tree_importance(
            trees.tree_attributions(prepared.test, trained.models[best], FEATURES)
        )
    sinks.write_artifacts(
        f"{out}/model", spark, best, as_of, FEATURES, trained.measured[best], prepared.n_train, prepared.n_test,
        importance, linear,
    )
    prepared.scaler.to_frame(spark).write.mode("overwrite").parquet(f"{out}/model/scaler")

    info = sinks.model_info(spark, f"{out}/model")
    held_out = frame.join(prepared.test.select("customer_id"), "customer_id", "left_semi")
    if linear is not None:
        scored = scoring.score(held_out, sinks.stored_linear_model(spark, f"{out}/model"))
    else:
        scored = serving.score(held_out, serving.load_model(spark, f"{out}/model", best, prepared.scaler))
    scored.write.mode("overwrite").parquet(f"{out}/check")
    own = training.predict(trained.models[best], prepared.test).select("customer_id", F.col("probability").alias("own"))
    again = spark.read.schema(scored.schema).parquet(f"{out}/check").select("customer_id", "probability")
    again.join(own, "customer_id").agg(
        F.count("*").alias("rows"), F.max(F.abs(F.col("probability") - F.col("own"))).alias("gap")
    ).write.mode("overwrite").parquet(f"{out}/reload_check")
    prepared.release()
    return info.filter(F.col("metric").isin(list(METRIC_TARGETS))).select("model_name", "metric", "value")
