"""Splits, folds, oversampling, metrics, attribution and training."""

from __future__ import annotations

import threading
import types
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from keepsake.operators import evaluate, explain, resampling, scoring, splits, training, trees, views
from keepsake.plans import job
from keepsake.schema import FEATURES
from keepsake.sources import sinks
from keepsake.sources.star_schema import AS_OF, retention_tables
from keepsake.storage import new_path

SF = "/root/testdata/sf0.01"


def labelled(spark, n=1000):
    return spark.range(n).select(
        F.concat(F.lit("c"), F.col("id")).alias("customer_id"), (F.col("id") % 7 == 0).cast("int").alias("churn")
    )


def test_split_sizes_and_stability(spark):
    df = labelled(spark)
    parts = splits.stratified_split(df)
    sizes = {(r["churn"], r["part"]): r["count"] for r in parts.groupBy("churn", "part").count().collect()}
    assert sizes == {(0, "train"): 686, (0, "test"): 171, (1, "train"): 114, (1, "test"): 29}
    again = splits.stratified_split(df.repartition(13))
    assert parts.exceptAll(again).count() == 0
    assert parts.exceptAll(splits.stratified_split(df, seed=7)).count() > 0


def test_folds_are_even_and_complete(spark):
    folds = splits.stratified_folds(labelled(spark), folds=5).groupBy("churn", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["churn"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in folds) == 1000


def test_scaler(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "customer_id string, x double, k double")
    scaler = splits.Scaler.fit(df, ["x", "k"])
    assert (scaler.mean, scaler.std) == ([2.0, 5.0], [1.0, 1.0])
    assert sorted(r["x"] for r in scaler.transform(df).collect()) == [-1.0, 1.0]


def cloud(spark, n, copies):
    """n random minority points, one of them held `copies` times more, among many majority rows."""
    rng = np.random.default_rng(3)
    points = [tuple(map(float, p)) for p in rng.normal(size=(n, 3))]
    points += [points[0]] * copies
    rows = [(f"m{i}", *p, 1) for i, p in enumerate(points)]
    rows += [(f"M{i}", 9.0, 9.0, 9.0, 0) for i in range(3 * len(points) + 5)]
    return points, spark.createDataFrame(rows, "customer_id string, a double, b double, c double, churn int")


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_neighbours_equal_brute_force(spark, block_rows):
    points, _ = cloud(spark, 40, 0)
    distinct = spark.createDataFrame(
        [(i, 1, list(p)) for i, p in enumerate(points)], "row_id long, copies long, x array<double>"
    )
    got = {}
    for r in resampling.nearest_neighbours(distinct, 5, block_rows).collect():
        got.setdefault(r["row_id"], {})[r["place"]] = r["other_id"]
    x = np.array(points)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [got[i][p] for p in range(1, 6)] == list(np.argsort(d[i])[:5])


def test_neighbour_search_passes_over_far_cells(spark, monkeypatch):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(25, 4))[draw.integers(25, size=2500)] * 10 + draw.normal(size=(2500, 4))
    distinct = spark.createDataFrame([(i + 1, [float(v) for v in row], 1) for i, row in enumerate(x)], "row_id long, x array<double>, copies long")
    met, compare = [], resampling._in_cells

    def counted(asking, cells, sizes, k):
        pairs = asking.groupBy("cell").count().join(sizes, "cell")
        met.append(pairs.agg(F.sum(F.col("count") * F.col("rows"))).first()[0])
        return compare(asking, cells, sizes, k)

    monkeypatch.setattr(resampling, "_in_cells", counted)
    got = resampling.nearest_neighbours(distinct, 5).orderBy("row_id", "place").collect()
    squares = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(squares, np.inf)
    want = np.sort(squares, axis=1)[:, :5]
    assert np.allclose(np.array([r["distance"] for r in got]).reshape(-1, 5), want)
    assert sum(met) < 2500**2 / 4


def test_cells_are_routed_in_frames_of_bounded_size(monkeypatch):
    monkeypatch.setattr(resampling, "MEASURED", 16)
    monkeypatch.setattr(resampling, "ROUTED", 50)
    draw = np.random.default_rng(3)
    x, pivots = draw.normal(size=(40, 3)), draw.normal(size=(20, 3))
    batch = pd.DataFrame({"row_id": np.arange(40), "x": list(x), "cell": np.arange(40) % 20, "bound": np.inf})
    frames = list(resampling.routed(batch, pivots, np.zeros(20)))
    assert max(map(len, frames)) <= 50
    pairs = pd.concat(frames)
    assert set(zip(pairs.row_id, pairs.cell)) == {(r, c) for r in range(40) for c in range(20) if c != r % 20} and len(pairs) == 40 * 19
    assert all((x[r] == v).all() for r, v in zip(pairs.row_id, pairs.x))


def test_learners_get_a_partition_per_core(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        prepared = training.prepare_split(views.feature_base(retention_tables(spark, SF)))
        assert prepared.train.rdd.getNumPartitions() == prepared.test.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        prepared.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_smote_balances_and_stays_on_segments(spark):
    points, df = cloud(spark, 30, 15)
    out = resampling.smote(df, ["a", "b", "c"], block_rows=16)
    sizes = {r["churn"]: r["count"] for r in out.groupBy("churn").count().collect()}
    assert sizes[0] == sizes[1]
    new = out.filter("synthetic")
    assert new.select("customer_id").distinct().count() == new.count()
    x = np.array(points)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    ends = set()
    for i in range(len(x)):
        near = sorted((d[i, j], j) for j in range(len(x)) if j != i)
        limit = near[4][0] + 1e-12
        ends |= {(i, j) for dist, j in near if dist <= limit}
    for r in new.collect():
        p = np.array([r["a"], r["b"], r["c"]])

        def on(i, j):
            u = x[j] - x[i]
            t = 0.0 if not u.any() else float((p - x[i]) @ u / (u @ u))
            return -1e-9 <= t <= 1 + 1e-9 and np.allclose(x[i] + t * u, p, atol=1e-9)

        assert any(on(i, j) for i, j in ends)
    assert out.exceptAll(resampling.smote(df, ["a", "b", "c"], block_rows=16)).count() == 0
    with pytest.raises(ValueError):
        resampling.smote(df.filter("churn = 0 OR customer_id IN ('m1', 'm2')"), ["a", "b", "c"])


def test_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 1)  # many ties
    df = spark.createDataFrame(
        [(int(a), float(b), int(b >= 0.5)) for a, b in zip(y, s)], "churn int, probability double, churn_prediction int"
    )
    got = {r["metric"]: r["value"] for r in evaluate.metrics(df).collect()}
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    ap, recall = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        held = s >= t
        ap += (y[held].sum() / y.sum() - recall) * y[held].mean()
        recall = y[held].sum() / y.sum()
    assert got["roc_auc"] == pytest.approx(auc) and got["avg_precision"] == pytest.approx(ap)
    p = s >= 0.5
    assert got["accuracy"] == pytest.approx((p == y).mean())
    assert got["precision"] == pytest.approx(y[p].mean()) and got["recall"] == pytest.approx(p[y == 1].mean())
    points = evaluate.roc_points(df).orderBy("fpr", "tpr").collect()
    assert points[0]["threshold"] is None and (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert cells[1, 1] == int((p & (y == 1)).sum()) and sum(cells.values()) == 300


def shapley(value, n):
    phi = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for size in range(n):
            for s in combinations(rest, size):
                w = factorial(size) * factorial(n - size - 1) / factorial(n)
                phi[i] += w * (value(set(s) | {i}) - value(set(s)))
    return phi


@pytest.mark.parametrize("learner", ["forest", "boosted"])
def test_tree_attribution_equals_brute_force(spark, learner):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] + x[:, 2] > 0.3)).astype(float)
    names = ["f0", "f1", "f2", "f3"]
    df = spark.createDataFrame(
        [(f"r{i:03d}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
        "customer_id string, f0 double, f1 double, f2 double, f3 double, label double",
    )
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    if learner == "forest":
        model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(data)
    else:
        model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(data)
    leaves = trees.ensemble_leaves(spark, model)

    def output(row):
        return sum(
            leaf.value
            for leaf in leaves
            if all(lo < row[f] <= hi for f, lo, hi in zip(leaf.features, leaf.low, leaf.high))
        )

    base = np.zeros(4)
    got = {}
    for r in trees.tree_attributions(df, model, names, max_rows=None).collect():
        got.setdefault(r["customer_id"], np.zeros(4))[r["position"]] = r["phi"]
    assert len(got) == 200
    for i in range(0, 200, 40):
        want = shapley(lambda s: output([x[i][f] if f in s else base[f] for f in range(4)]), 4)
        assert np.allclose(got[f"r{i:03d}"], want, atol=1e-9)
        assert got[f"r{i:03d}"].sum() == pytest.approx(output(x[i]) - output(base))
    assert trees.tree_attributions(df, model, names, max_rows=10).select("customer_id").distinct().count() == 10
    ranked = trees.tree_importance(trees.tree_attributions(df, model, names, max_rows=None)).collect()
    assert ranked[-1]["feature"] == "f3"


@pytest.fixture(scope="module")
def trained(spark):
    base = views.feature_base(retention_tables(spark, SF))
    return training.train_models(
        base,
        {
            "LogisticRegression": training.fit_logistic,
            "GradientBoosting": lambda p: training.fit_boosted(p, rounds=5, depth=3),
        },
    )


def test_learners_are_fitted_side_by_side(monkeypatch):
    """Each waits for the others before it ends; the results keep the order of the learners."""
    met, prepared = threading.Barrier(3), []
    monkeypatch.setattr(training, "prepare_split", lambda base, **settings: prepared.append(settings) or types.SimpleNamespace(test=None))
    monkeypatch.setattr(training, "test_metrics", lambda model, test: {"roc_auc": model})
    learners = {name: lambda _, auc=auc: (met.wait(30), auc)[1] for name, auc in (("a", 0.5), ("b", 0.7), ("c", 0.7))}
    found = training.train_models(None, learners)
    assert list(found.models) == list(found.measured) == ["a", "b", "c"] and found.best == "b" and prepared[0]["learners"] == 3


def test_learners_side_by_side_share_the_cores():
    assert [training.parts(cores, 1000, n) for cores, n in ((12, 1), (12, 3), (48, 3), (4, 3), (2, 3))] == [12, 4, 16, 4, 2]
    assert training.parts(12, 10_000_000, 3) == training.parts(12, 10_000_000) > 48  # by bytes


def test_models_find_the_signal(spark, trained):
    assert trained.measured["LogisticRegression"]["roc_auc"] > 0.95
    assert trained.measured["GradientBoosting"]["roc_auc"] > 0.9
    table = evaluate.compare_models(trained.long(spark)).collect()
    assert table[0]["is_best"] and table[0]["model"] == trained.best and len(table) == 2
    assert (trained.prepared.n_train, trained.prepared.n_test) == (1200, 300)
    sizes = {r["churn"]: r["count"] for r in trained.prepared.train.groupBy("churn").count().collect()}
    assert sizes[0] == sizes[1]


def test_coefficient_table_scores_like_the_model(spark, trained):
    prepared, model = trained.prepared, trained.models["LogisticRegression"]
    from keepsake.operators.features import training_frame

    frame = training_frame(views.feature_base(retention_tables(spark, SF)))
    linear = training.to_linear(model, prepared.scaler)
    ours = scoring.score(frame, linear).select("customer_id", F.col("probability").alias("p"))
    theirs = training.predict(model, prepared.test)
    gap = theirs.join(ours, "customer_id").agg(F.max(F.abs(F.col("p") - F.col("probability"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == 300
    # attributions add up to the logit's distance from the background
    long = explain.attributions(frame, linear)
    sums = long.groupBy("customer_id").agg(F.sum("phi").alias("s")).join(ours, "customer_id")
    off = sums.agg(F.max(F.abs(F.col("s") + linear.intercept - F.log(F.col("p") / (1 - F.col("p")))))).first()[0]
    assert off < 1e-5


@pytest.mark.parametrize("leaky", [False, True])
def test_cross_validation(spark, leaky):
    base = views.feature_base(retention_tables(spark, "/root/testdata/sf0.001"))
    scores = training.cross_validate(base, training.fit_forest, folds=2, leaky=leaky, trees=5, depth=3)
    rows = {r["metric"]: r for r in scores.collect()}
    assert set(rows) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert 0.7 < rows["roc_auc"]["mean"] <= 1.0 and rows["roc_auc"]["std"] >= 0


def test_job_end_to_end(spark):
    out = new_path(spark, "job")
    tables = retention_tables(spark, "/root/testdata/sf0.001")
    measured = job.run(tables, out, AS_OF, {"LogisticRegression": training.fit_logistic})
    assert evaluate.check_targets(measured).count() == 4
    assert spark.read.option("header", True).csv(f"{out}/features").count() == 150
    assert sinks.stored_importance(spark, f"{out}/model").count() == 20
    assert sinks.stored_stats(spark, f"{out}/model").median_monthly > 0
    assert spark.read.parquet(f"{out}/check").count() == 30
    assert spark.read.parquet(f"{out}/reload_check").first()["gap"] < 1e-9
    log = spark.read.parquet(f"{out}/runs")
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"param", "metric"}
    info = sinks.model_info(spark, f"{out}/model").first()
    assert (info["n_features"], info["n_training_samples"], info["n_test_samples"]) == (61, 120, 30)


def test_job_with_a_tree_model(spark):
    out = new_path(spark, "job")
    tables = retention_tables(spark, "/root/testdata/sf0.001")
    small = {
        "RandomForest": lambda p: training.fit_forest(p, trees=5, depth=3),
        "GradientBoosting": lambda p: training.fit_boosted(p, rounds=3, depth=2),
    }
    assert job.run(tables, out, AS_OF, small, cv_folds=2).count() == 4
    assert spark.read.parquet(f"{out}/reload_check").first().asDict() == {"rows": 30, "gap": 0.0}
    logged = {(r["model"], r["name"]) for r in spark.read.parquet(f"{out}/runs").collect()}
    assert {(m, f"cv_{x}_{k}") for m in small for x in ("f1", "roc_auc") for k in ("mean", "std")} <= logged
    assert sinks.stored_importance(spark, f"{out}/model", top=None).count() == len(FEATURES)
