"""Attribution of tree ensembles against one baseline record.

For one tree and one record, the value of a coalition of features is the tree's output
when those features come from the record and the rest from the baseline. Every leaf then
has a closed form: with A the path features only the record satisfies and B those only the
baseline satisfies (a leaf no mixture can reach adds nothing), each feature of A gets
v * (a-1)! b! / (a+b)! and each of B loses v * a! (b-1)! / (a+b)!. The attributions of a
record add up to its output minus the baseline's.

The model is a bounded table (trees x nodes), read from its saved form and shipped to the
tasks; records stay partitioned and are handled in Arrow batches.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators.splits import hash_order
from keepsake.storage import new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package


@dataclass(frozen=True)
class Leaf:
    """Bounds per path feature (low < x <= high) and the leaf's weighted value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: float


def ensemble_leaves(spark: SparkSession, model) -> list[Leaf]:
    """Leaves of a fitted forest (probability of class 1) or boosted ensemble (margin)."""
    path = new_path(spark, "trees")
    model.write().save(path)
    averaged = model.__class__.__name__.startswith("RandomForest")
    weights = list(model.treeWeights)
    total = sum(weights)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    trees: dict[int, dict[int, dict]] = {}
    for row in nodes.toLocalIterator():  # bounded by the model: trees x 2^(depth+1)
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    leaves: list[Leaf] = []
    for tree, by_id in trees.items():
        todo = [(0, {})]
        while todo:
            at, bounds = todo.pop()
            node = by_id[at]
            if node["leftChild"] < 0:
                value = node["prediction"] * weights[tree]
                if averaged:
                    stats = node["impurityStats"]
                    value = stats[1] / sum(stats) * weights[tree] / total
                used = sorted(bounds)
                leaves.append(
                    Leaf(
                        np.array(used, dtype=int),
                        np.array([bounds[f][0] for f in used]),
                        np.array([bounds[f][1] for f in used]),
                        float(value),
                    )
                )
                continue
            feature = node["split"]["featureIndex"]
            threshold = node["split"]["leftCategoriesOrThreshold"][0]
            low, high = bounds.get(feature, (-np.inf, np.inf))
            todo.append((node["leftChild"], {**bounds, feature: (low, min(high, threshold))}))
            todo.append((node["rightChild"], {**bounds, feature: (max(low, threshold), high)}))
    return leaves


def _shares(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of an A feature and of a B feature for set sizes a, b up to `most`."""
    gain, loss = np.zeros((most + 1, most + 1)), np.zeros((most + 1, most + 1))
    for a in range(most + 1):
        for b in range(most + 1):
            if a:
                gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return gain, loss


def batch_attributions(x: np.ndarray, baseline: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    gain, loss = _shares(max((len(leaf.features) for leaf in leaves), default=0))
    phi = np.zeros_like(x)
    for leaf in leaves:
        if not len(leaf.features):
            continue
        part, base = x[:, leaf.features], baseline[leaf.features]
        fits = (part > leaf.low) & (part <= leaf.high)
        base_fits = (base > leaf.low) & (base <= leaf.high)
        reachable = (fits | base_fits).all(axis=1)
        if not reachable.any():
            continue
        only_x = fits & ~base_fits & reachable[:, None]
        only_base = ~fits & base_fits & reachable[:, None]
        a, b = only_x.sum(axis=1), only_base.sum(axis=1)
        phi[:, leaf.features] += leaf.value * (only_x * gain[a, b][:, None] - only_base * loss[a, b][:, None])
    return phi


def sample_rows(df: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """A reproducible sample: the first rows of a seeded shuffle (a top-k, no full sort)."""
    return df.orderBy(hash_order("customer_id", seed), "customer_id").limit(most)


def tree_attributions(
    scaled: DataFrame, model, features: list[str], baseline: list[float] | None = None, max_rows: int | None = None
) -> DataFrame:
    """Long form (customer_id, position, feature, phi); the baseline is the scaled mean, all zeros.

    Every record is explained; `max_rows` asks for a sample instead.
    """
    leaves = ensemble_leaves(scaled.sparkSession, model)
    origin = np.zeros(len(features)) if baseline is None else np.asarray(baseline, dtype=float)
    records = scaled.select("customer_id", *[F.col(c).cast("double").alias(c) for c in features])
    if max_rows is not None:
        records = sample_rows(records, max_rows)

    def explain(batches):
        for batch in batches:
            phi = batch_attributions(batch[features].to_numpy(), origin, leaves)
            yield pd.DataFrame({"customer_id": batch["customer_id"], "phi": list(phi)})

    names = F.array(*[F.lit(f) for f in features])
    return (
        records.mapInPandas(explain, "customer_id string, phi array<double>")
        .select("customer_id", F.posexplode("phi").alias("position", "phi"))
        .select("customer_id", "position", names[F.col("position")].alias("feature"), "phi")
    )


def tree_importance(attributed: DataFrame) -> DataFrame:
    return (
        attributed.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
