"""Trees in shared passes against plain versions, and attributions against all coalitions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import evaluate, histogram_trees as ht, path_attribution as pa_, validation, views
from keepsake.plans.registry import all_queries
from keepsake.schema import FEATURES
from keepsake.sources.star_schema import retention_tables

SF = "/root/testdata/sf0.001"
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(5)
    rows = []
    for model in (1, 2):
        x = np.column_stack([draw.integers(0, 6, 300), draw.normal(size=300).round(2), draw.integers(0, 2, 300), draw.exponential(size=300).round(1)])
        y = (x[:, 0] + 2 * x[:, 2] + draw.normal(size=300) > 3.5).astype(int)
        rows += [(model, f"c{model}-{i}", int(y[i]), *map(float, x[i])) for i in range(300)]
    return spark.createDataFrame(rows, "model int, customer_id string, churn int, a double, b double, c double, d double").cache()


@pytest.fixture(scope="module")
def whole(frame):
    return ht.Training(frame, NAMES)


@pytest.fixture(scope="module")
def spread(frame):
    return ht.Training(frame, NAMES, block_rows=70)


BOOSTING, FOREST = ht.Boosting(rounds=6, depth=3), ht.Forest(trees=9, depth=5, min_split=12, min_leaf=4)


@pytest.mark.parametrize("p", [BOOSTING, FOREST, ht.Newton()], ids=["boosting", "forest", "newton"])
def test_shared_passes_equal_growing_in_one_task(whole, spread, p):
    assert max(whole.split.values()) == 1 and min(spread.split.values()) > 1
    one, many = whole.grow(p), spread.grow(p)
    assert set(one) == set(many) == {1, 2}
    for m in one:
        if isinstance(p, ht.Newton):
            assert np.allclose(one[m], many[m], atol=1e-9)
            continue
        for name in ("feature", "bin", "threshold", "rows"):
            assert (getattr(one[m], name) == getattr(many[m], name)).all()
        assert np.allclose(one[m].value, many[m].value) and np.allclose(one[m].cover, many[m].cover)


def test_a_model_of_60000_rows_needs_no_pass_per_level(spark):
    rows = spark.range(60_000).selectExpr("0 AS model", "CAST(id AS STRING) AS customer_id", "CAST(id % 3 = 0 AS INT) AS churn", "id % 7 AS a", "id % 11 AS b")
    training = ht.Training(rows, ["a", "b"])
    assert training.split == {0: 1}
    assert int(training.grow(ht.Boosting(rounds=2, depth=2))[0].rows[0, 0]) > 40_000  # four in five rows are drawn
    training.release()


def blocks(training):
    rows = training.blocks.toArrow().combine_chunks().to_batches()[0]
    return {b.model: b for b in (ht.read_block(rows, i, len(NAMES)) for i in range(len(rows)))}


def test_boosted_trees_equal_a_plain_version(whole):
    """Every split by trying all thresholds row by row."""
    p = BOOSTING
    for m, block in blocks(whole).items():
        trees, shape, margin = whole.grow(p)[m], whole.shapes[m], np.zeros(len(block.y))
        for at in range(p.rounds):
            odds = 1 / (1 + np.exp(-margin))
            w = np.where(block.y == 1, shape.heavy, 1.0)
            g, h = (odds - block.y) * w, odds * (1 - odds) * w
            taken = ht.uniform(block.ids, p.seed, m, at) < p.rows
            columns = ht.boost_columns(p, len(NAMES), m, at)
            held = {0: taken}
            for node in range((1 << p.depth) - 1):
                if node not in held:
                    continue
                rows = held[node]
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p.l2)
                best = (1e-6, None, None)
                for f in columns:
                    for cut in shape.edges[f]:
                        left = rows & (block.x[:, f] <= cut)
                        right = rows & ~left
                        if min(h[left].sum(), h[right].sum()) >= p.min_child:
                            gain = round(score(left) + score(right) - score(rows), 9)
                            if gain > best[0]:
                                best = (gain, f, cut)
                assert trees.feature[at, node] == (-1 if best[1] is None else best[1])
                assert np.isclose(trees.value[at, node], -p.eta * g[rows].sum() / (h[rows].sum() + p.l2))
                if best[1] is not None:
                    assert trees.threshold[at, node] == best[2]
                    held[2 * node + 1] = rows & (block.x[:, best[1]] <= best[2])
                    held[2 * node + 2] = rows & (block.x[:, best[1]] > best[2])
            margin += trees.value[at, trees.nodes_of(at, block.bins)]
        assert np.allclose(trees.sums(block.x), margin)


def test_no_small_node_of_a_forest_is_split(whole):
    for trees in whole.grow(FOREST).values():
        split = trees.feature >= 0
        assert split.any() and trees.rows[split].min() >= FOREST.min_split
        tree, node = np.nonzero(split)
        for child in (2 * node + 1, 2 * node + 2):
            assert trees.rows[tree, child].min() >= FOREST.min_leaf
        assert (trees.rows[tree, node] == trees.rows[tree, 2 * node + 1] + trees.rows[tree, 2 * node + 2]).all()


@pytest.mark.parametrize("p", [BOOSTING, FOREST], ids=["boosting", "forest"])
def test_trees_of_a_model_of_several_blocks_grow_in_one_task(whole, frame, monkeypatch, p):
    """One pass over its blocks, not one a level."""
    monkeypatch.setattr(ht, "WHOLE_ROWS", 100)
    monkeypatch.setattr(ht, "BLOCK_ROWS", 70)
    training = ht.Training(frame, NAMES)
    assert min(training.split.values()) > 1
    monkeypatch.setattr(training, "_summed", None)
    one, sent = whole.grow(p), training.grow(p)
    training.release()
    for m in (1, 2):
        for name in ("feature", "bin", "threshold", "rows"):
            assert (getattr(one[m], name) == getattr(sent[m], name)).all()
        assert np.allclose(one[m].value, sent[m].value) and np.allclose(one[m].cover, sent[m].cover)


def test_columns_packed_in_a_line_have_their_own_sums():
    draw = np.random.default_rng(1)
    values = [2, 64, 3, 2, 1, 5, 2, 40, 2, 2, 2]
    bins = np.column_stack([draw.integers(0, v, 500) for v in values]).astype(np.uint8)
    edges, columns = [np.arange(v - 1.0) for v in values], np.array([0, 1, 2, 4, 5, 7, 9, 10])
    g, h, nodes = draw.normal(size=500), draw.random(500), draw.integers(0, 3, 500)
    lines, groups = ht.packed_lines(bins, edges)
    assert len(lines) < len(values) and sorted(c for group in groups for c, _, _ in group) == list(range(len(values)))
    got = ht.packed_histogram(list(lines), groups, columns, nodes, g, h, 3)
    want = ht.boost_histogram(bins.T[columns], nodes, g, h, np.arange(3), 3)
    assert np.allclose(got[..., :2], want[..., :2], atol=1e-12)


def test_newton_weights_have_no_slope_left(whole):
    for m, block in blocks(whole).items():
        w, shape = whole.grow(ht.Newton())[m], whole.shapes[m]
        slope = ht.newton_sums(block, w, shape.balanced)[: len(w)] + np.append(w[:-1], 0)
        assert np.abs(slope).max() < 1e-5


def test_predictions_go_to_the_rows_own_model(whole, frame):
    for p in (BOOSTING, FOREST, ht.Newton()):
        models = whole.grow(p)
        got = {r.customer_id: r for r in ht.predict(frame, NAMES, models, p).collect()}
        for r in frame.sample(0.1, seed=1).collect():
            x = np.array([[r.a, r.b, r.c, r.d]])
            found = models[r.model]
            want = found[:-1] @ x[0] + found[-1] if isinstance(p, ht.Newton) else found.sums(x)[0]
            want = want / p.trees if isinstance(p, ht.Forest) else 1 / (1 + np.exp(-want))
            assert np.isclose(got[r.customer_id].probability, want) and got[r.customer_id].churn == r.churn


def test_attributions_equal_all_coalitions(whole, frame):
    """Conditional expectations over every subset of features, tree by tree."""

    def value(trees, tree, node, x, known):
        f = int(trees.feature[tree, node])
        if f < 0:
            return trees.value[tree, node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            return value(trees, tree, left if x[f] <= trees.threshold[tree, node] else right, x, known)
        share = trees.cover[tree, left] / trees.cover[tree, node]
        return share * value(trees, tree, left, x, known) + (1 - share) * value(trees, tree, right, x, known)

    n = len(NAMES)
    for p, averaged in ((BOOSTING, False), (FOREST, True)):
        trees = whole.grow(p)[1]
        rows = frame.filter("model = 1").orderBy("customer_id").limit(12)
        found = {}
        for r in pa_.attributions(rows, trees, NAMES, averaged).collect():
            found.setdefault(r.customer_id, {})[r.feature] = r.phi
        scale = 1 / p.trees if averaged else 1.0
        leaves = pa_.path_leaves(trees, scale)
        for r in rows.collect():
            x = np.array([r.a, r.b, r.c, r.d])
            worth = {k: scale * sum(value(trees, t, 0, x, k) for t in range(len(trees.feature))) for s in range(n + 1) for k in combinations(range(n), s)}
            for j, name in enumerate(NAMES):
                phi = sum(
                    factorial(len(k)) * factorial(n - 1 - len(k)) / factorial(n) * (worth[tuple(sorted((*k, j)))] - worth[k])
                    for k in worth if j not in k
                )
                assert np.isclose(found[r.customer_id][name], phi, atol=1e-9)
            assert np.isclose(sum(found[r.customer_id].values()), trees.sums(x[None])[0] * scale - pa_.expected(leaves))


def test_attributions_of_many_leaves_equal_the_plain_form(whole, frame, monkeypatch):
    trees = whole.grow(FOREST)[1]
    leaves, rows = pa_.path_leaves(trees, 1 / FOREST.trees), frame.filter("model = 1").toPandas()
    x = rows[NAMES].to_numpy(float)
    x[0, 1], x[1, 2], x[2, 3] = np.nan, np.inf, -np.inf
    plain = np.zeros_like(x)
    for leaf in leaves:
        if d := len(leaf.features):
            part = x[:, leaf.features]
            met = ((part > leaf.low) & (part <= leaf.high)).astype(float)
            plain[:, leaf.features] += pa_.pattern_values(leaf, met)
    asked, found = [], np.polynomial.legendre.leggauss
    monkeypatch.setattr(np.polynomial.legendre, "leggauss", lambda n: asked.append(n) or found(n))
    assert np.allclose(pa_.batch_attributions(x, leaves), plain, atol=1e-12)
    assert len(asked) <= len(NAMES)  # not once per leaf and batch


def test_odd_training_rows(spark, frame):
    rows = frame.filter("model = 1").unionByName(frame.filter("model = 1").withColumn("churn", F.lit(None).cast("int")))
    one = rows.withColumn("d", F.lit(3.0))
    training = ht.Training(one, NAMES)
    assert sum(training.shapes[1].counts) == 300
    trees = training.grow(BOOSTING)[1]
    assert not (trees.feature == 3).any()
    only = ht.Training(frame.filter("model = 1 and churn = 0"), NAMES)
    assert np.isfinite(only.grow(BOOSTING)[1].value).all() and (only.grow(FOREST)[1].feature == -1).all()


def test_cross_validation_equals_folds_one_by_one(spark):
    base = views.feature_base(retention_tables(spark, SF))
    learners = {"LogisticRegression": ht.Newton(), "RandomForest": ht.Forest(trees=8, depth=4), "GradientBoosting": ht.Boosting(rounds=5, depth=3)}
    train, held = validation.fold_rows(base, folds=3)
    train, held = train.cache(), held.cache()
    scores = validation.fold_scores(base, learners, folds=3)
    got = {(r.model, r.fold, r.metric): r.value for r in validation.fold_metrics(scores).collect()}
    assert len(got) == 3 * 3 * 5
    for fold in (1, 2, 3):
        alone = ht.Training(train.filter(F.col("model") == fold), FEATURES)
        for name, p in learners.items():
            predicted = ht.predict(held.filter(F.col("model") == fold), FEATURES, alone.grow(p), p)
            for r in evaluate.metrics(predicted).filter("metric <> 'avg_precision'").collect():
                assert np.isclose(got[name, fold, r.metric], r.value)
    means = {(r.model, r.metric): (r["mean"], r["std"]) for r in validation.summary(validation.fold_metrics(scores)).collect()}
    for (name, metric), (mean, std) in means.items():
        values = [got[name, fold, metric] for fold in (1, 2, 3)]
        assert np.isclose(mean, np.mean(values)) and np.isclose(std, np.std(values))


def test_tree_reasons_are_the_largest_attributions(spark):
    rows = all_queries()["p04b_tree_reasons"](spark, SF).collect()
    by_customer = {}
    for r in rows:
        by_customer.setdefault(r.customer_id, []).append(r)
        assert r.adds_up and r.impact == abs(r.shap_value) and r.direction == ("increases" if r.shap_value > 0 else "decreases")
        assert r.description.endswith(f"{r.direction} churn risk") and r.feature in FEATURES
    for own in by_customer.values():
        own.sort(key=lambda r: r.reason_rank)
        assert [r.reason_rank for r in own] == [1, 2, 3] and own[0].impact >= own[1].impact >= own[2].impact


def test_registered_learners_measure_test_rows(spark):
    for key in ("m06b_histogram_forest", "m07b_second_order_boosting"):
        rows = {r.metric: r.value for r in all_queries()[key](spark, SF).collect()}
        assert len(rows) == 6 and 0.6 < rows["roc_auc"] <= 1
