"""Training, cross-validation and comparison of the three classifiers."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import evaluate
from keepsake.operators.features import FeatureStats, training_frame
from keepsake.operators.resampling import smote
from keepsake.operators.scoring import LinearModel
from keepsake.operators.splits import Scaler, class_weights, stratified_folds, stratified_split
from keepsake.schema import FEATURES, literal_rows

SEED = 42
#: Bytes of a partition that the learners pass over, at most, and partitions of one of several learners, at least.
PART_BYTES, LEAST_PARTS = 64 << 20, 4


@dataclass
class Prepared:
    """Scaled train rows (balanced) and test rows, with what was learnt on the way."""

    train: DataFrame
    test: DataFrame
    scaler: Scaler
    scale_pos_weight: float
    n_train: int
    n_test: int

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def parts(cores: int, rows: int, learners: int = 1) -> int:
    """Partitions for learners that pass over the rows hundreds of times: one per core, as every
    further one costs two tasks a pass, and more where they would grow over PART_BYTES. Learners
    that are fitted side by side share the cores."""
    size = rows * (len(FEATURES) + 2) * 8
    return max(min(cores, max(LEAST_PARTS, -(-cores // learners))), -(-size // PART_BYTES))


def dealt(frame: DataFrame, rows: int, learners: int = 1) -> DataFrame:
    """Even partitions, `parts` of them."""
    return frame.repartition(parts(frame.sparkSession.sparkContext.defaultParallelism, rows, learners))


def prepare(train: DataFrame, test: DataFrame, resample: bool = True, seed: int = SEED, learners: int = 1) -> Prepared:
    """Scale by the train rows, oversample the train rows, keep both in memory for the learners, of
    which ``learners`` are fitted side by side."""
    scaler = Scaler.fit(train, FEATURES)
    counts = class_weights(train).collect()  # two rows
    sizes = [r["n"] for r in counts]
    scaled, held_out = scaler.transform(train), dealt(scaler.transform(test), sum(sizes)).persist()
    balanced = smote(scaled, FEATURES, seed=seed) if resample else scaled
    return Prepared(
        dealt(balanced, max(sizes, default=0) * 2 if resample else sum(sizes), learners).persist(),
        held_out,
        scaler,
        counts[0]["scale_pos_weight"],
        sum(sizes),
        held_out.count(),
    )


def prepare_split(
    base: DataFrame,
    test_share: float = 0.2,
    resample: bool = True,
    seed: int = SEED,
    stats: FeatureStats | None = None,
    learners: int = 1,
) -> Prepared:
    """Features over the whole frame, then the stratified split."""
    frame = stratified_split(training_frame(base, stats), test_share=test_share, seed=seed).persist()
    prepared = prepare(
        frame.filter("part = 'train'").drop("part"), frame.filter("part = 'test'").drop("part"), resample, seed, learners
    )
    prepared.train.count()  # both parts are cached now, so the joint frame can go
    frame.unpersist()
    return prepared


def assemble(frame: DataFrame, weights: dict[int, float]) -> DataFrame:
    built = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(frame)
    return built.select(
        "customer_id",
        "features",
        F.col("churn").cast("double").alias("label"),
        "churn",
        F.when(F.col("churn") == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0)).alias("weight"),
    )


def balanced_weights(frame: DataFrame) -> tuple[dict[int, float], float]:
    """n/(2*n_c) per class of the rows the learner sees, and their weighted total."""
    rows = class_weights(frame).collect()  # two rows
    return {r["churn"]: r["weight"] for r in rows}, float(sum(r["n"] * r["weight"] for r in rows))


def fit_logistic(prepared: Prepared, c: float = 1.0, max_iter: int = 1000):
    """L2 penalty 1/C against the summed loss equals 1/(C * total weight) against the mean loss."""
    weights, total = balanced_weights(prepared.train)
    learner = LogisticRegression(
        maxIter=max_iter, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, weightCol="weight"
    )
    return learner.fit(assemble(prepared.train, weights))


def fit_forest(prepared: Prepared, trees: int = 200, depth: int = 10, min_leaf: int = 2, seed: int = SEED):
    weights, _ = balanced_weights(prepared.train)
    learner = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, weightCol="weight", seed=seed
    )
    return learner.fit(assemble(prepared.train, weights))


def fit_boosted(
    prepared: Prepared, rounds: int = 200, depth: int = 6, eta: float = 0.1, rows: float = 0.8,
    columns: float = 0.8, seed: int = SEED,
):
    learner = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=eta, subsamplingRate=rows, featureSubsetStrategy=str(columns),
        weightCol="weight", seed=seed,
    )
    return learner.fit(assemble(prepared.train, {1: prepared.scale_pos_weight}))


LEARNERS: dict[str, Callable] = {
    "LogisticRegression": fit_logistic,
    "RandomForest": fit_forest,
    "GradientBoosting": fit_boosted,
}


def predict(model, scaled: DataFrame) -> DataFrame:
    scored = model.transform(assemble(scaled, {})).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(
        "customer_id", "churn", "probability", (F.col("probability") >= 0.5).cast("int").alias("churn_prediction")
    )


def test_metrics(model, scaled: DataFrame) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in evaluate.metrics(predict(model, scaled)).collect()}  # six rows


def to_linear(model, scaler: Scaler, name: str = "LogisticRegression") -> LinearModel:
    """The fitted regression as a plain coefficient table for expression scoring."""
    return LinearModel(
        name, scaler.features, scaler.mean, scaler.std, [float(v) for v in model.coefficients], float(model.intercept)
    )


def cross_validate(
    base: DataFrame, learner: Callable, folds: int = 5, leaky: bool = False, seed: int = SEED, **params
) -> DataFrame:
    """`cross_validate_models` for one learner."""
    found = cross_validate_models(base, {"": lambda prepared: learner(prepared, **params)}, folds, leaky, seed)
    return found.drop("model")


def cross_validate_models(
    base: DataFrame, learners: dict[str, Callable], folds: int = 5, leaky: bool = False, seed: int = SEED
) -> DataFrame:
    """Mean and deviation of the test metrics over stratified folds, for each learner; a fold
    is prepared once for all of them.

    Feature statistics, scaler and oversampling are fitted inside each fold. With `leaky`
    the rows are oversampled once before folding, so held-out rows have relatives among
    the training rows; it exists to reproduce such figures, not to judge a model.
    """
    if leaky:
        frame = training_frame(base)
        resampled = smote(Scaler.fit(frame, FEATURES).transform(frame), FEATURES, seed=seed).drop("synthetic")
        folded = stratified_folds(resampled, folds=folds, seed=seed).persist()
    else:
        folded = stratified_folds(base.withColumn("churn", F.col("churn").cast("int")), folds=folds, seed=seed).persist()
    scores: dict[tuple[str, str], list[float]] = {}
    for fold in range(1, folds + 1):
        kept = folded.filter(F.col("fold") != fold).drop("fold")
        held = folded.filter(F.col("fold") == fold).drop("fold")
        if leaky:
            prepared = prepare(kept, held, resample=False, seed=seed)
        else:
            stats = FeatureStats.fit(kept)
            prepared = prepare(
                training_frame(kept, stats, "fitted"), training_frame(held, stats, "fitted"), seed=seed
            )
        for name, learner in learners.items():
            for metric, value in test_metrics(learner(prepared), prepared.test).items():
                scores.setdefault((name, metric), []).append(value)
        prepared.release()
    folded.unpersist()
    wanted = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    rows = [(name, m, fmean(scores[name, m]), pstdev(scores[name, m])) for name in learners for m in wanted]
    return literal_rows(base.sparkSession, rows, ["model", "metric", "mean", "std"])


@dataclass
class Trained:
    prepared: Prepared
    models: dict[str, object] = field(default_factory=dict)
    measured: dict[str, dict[str, float]] = field(default_factory=dict)
    validated: list = field(default_factory=list)  # rows of `cross_validate_models`

    @property
    def best(self) -> str:
        """Highest ROC-AUC; an earlier model keeps its place on a tie."""
        return max(self.measured, key=lambda name: self.measured[name]["roc_auc"])

    def long(self, spark: SparkSession) -> DataFrame:
        rows = [
            (order, name, metric, float(value))
            for order, (name, values) in enumerate(self.measured.items(), start=1)
            for metric, value in values.items()
        ]
        return literal_rows(spark, rows, ["model_order", "model", "metric", "value"])


def train_models(
    base: DataFrame,
    learners: dict[str, Callable] | None = None,
    resample: bool = True,
    stats: FeatureStats | None = None,
    cv_folds: int = 0,
) -> Trained:
    """Every learner fitted and tested on one split, side by side; with `cv_folds` also cross-validated."""
    learners = learners or LEARNERS
    trained = Trained(prepare_split(base, resample=resample, stats=stats, learners=len(learners)))
    if cv_folds:
        trained.validated = cross_validate_models(base, learners, cv_folds).collect()  # five rows a learner

    def fit(learner: Callable) -> tuple:
        model = learner(trained.prepared)
        return model, test_metrics(model, trained.prepared.test)

    with ThreadPoolExecutor(len(learners)) as pool:  # their jobs share the cluster: boosting is a thousand short ones
        for name, (model, measured) in zip(learners, pool.map(fit, learners.values())):
            trained.models[name], trained.measured[name] = model, measured
    return trained


def log_runs(trained: Trained, path: str, spark: SparkSession, run_id: str, started: str) -> None:
    """Append one run per model: its parameters and metrics in long form."""
    params = []
    for name, model in trained.models.items():
        for param, value in sorted(model.extractParamMap().items(), key=lambda kv: kv[0].name):
            params.append((run_id, started, name, "param", param.name, str(value)))
    metrics = [
        (run_id, started, name, "metric", f"test_{metric}", repr(value))
        for name, values in trained.measured.items()
        for metric, value in values.items()
    ]
    metrics += [
        (run_id, started, r["model"], "metric", f"cv_{r['metric']}_{kind}", repr(r[kind]))
        for r in trained.validated
        for kind in ("mean", "std")
    ]
    literal_rows(spark, params + metrics, ["run_id", "started", "model", "kind", "name", "value"]).coalesce(
        1
    ).write.mode("append").parquet(path)
