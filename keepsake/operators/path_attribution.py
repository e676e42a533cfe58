"""Path-dependent attribution of tree ensembles, from the trees' own cover counts.

The value of a coalition of features is the tree's expected output when the record goes its
own way at splits on these features and both ways, by the share of training rows, at all
others. A leaf with path features 1..d is reached with weight prod_i (o_i or z_i): o_i is 1 if
the record meets all conditions on feature i, z_i the share of rows that do. Its Shapley values
are v * (o_j - z_j) * integral over t of prod_{i != j} (z_i (1 - t) + o_i t), a polynomial that
a few quadrature points integrate exactly. Records that meet the same conditions of a leaf
share its values, so they are computed once per pattern that occurs and looked up.

The model is a bounded table (trees x nodes) shipped to the tasks; records stay partitioned.
Attributions of a record add up to its output minus the expected output.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.histogram_trees import Trees

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package


@dataclass(frozen=True)
class PathLeaf:
    """Path features with bounds (low < x <= high) and shares of rows, and the leaf's value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray
    value: float


def path_leaves(trees: Trees, scale: float = 1.0) -> list[PathLeaf]:
    """The leaves of all trees; a leaf no training row reached has no weight and is left out."""
    leaves = []
    for tree in range(len(trees.feature)):
        waiting: list[tuple[int, dict]] = [(0, {})]
        while waiting:
            at, path = waiting.pop()
            feature = int(trees.feature[tree, at])
            if feature < 0:
                names = sorted(path)
                low, high, shares = (np.array([path[f][i] for f in names], float) for i in range(3))
                leaves.append(PathLeaf(np.array(names, int), low, high, shares, scale * float(trees.value[tree, at])))
                continue
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            cut, whole = trees.threshold[tree, at], trees.cover[tree, at]
            for child, bounds in ((2 * at + 1, (low, min(high, cut))), (2 * at + 2, (max(low, cut), high))):
                part = trees.cover[tree, child] / whole
                if part > 0:
                    waiting.append((child, path | {feature: (*bounds, share * part)}))
    return leaves


def expected(leaves: list[PathLeaf]) -> float:
    return float(sum(leaf.value * leaf.shares.prod() for leaf in leaves))


_quadratures: dict = {}


def quadrature(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in [0, 1] and weights that integrate polynomials of d - 1 exactly, found once per d."""
    if d not in _quadratures:
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        _quadratures[d] = (points + 1) / 2, weights / 2
    return _quadratures[d]


def pattern_values(leaf: PathLeaf, patterns: np.ndarray) -> np.ndarray:
    """Attributions of the leaf's features for each pattern of met conditions (0 or 1 each)."""
    t, weights = quadrature(len(leaf.shares))
    terms = leaf.shares[:, None] * (1 - t) + patterns[:, :, None] * t  # never 0: shares are above 0
    others = terms.prod(axis=1, keepdims=True) / terms
    return leaf.value * (patterns - leaf.shares) * (others @ weights)


def ranked_bounds(leaves: list[PathLeaf], features: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Per feature the ascending finite bounds that occur, and per leaf its bounds as places
    among them, so a value's place tells on which side of a bound it is."""
    found: list[set] = [set() for _ in range(features)]
    for leaf in leaves:
        for f, low, high in zip(leaf.features, leaf.low, leaf.high):
            found[f].update(b for b in (low, high) if np.isfinite(b))
    cuts = [np.array(sorted(s), float) for s in found]
    place = [{b: i for i, b in enumerate(c.tolist())} | {-np.inf: -1, np.inf: len(c)} for c in cuts]
    ends = [
        (np.array([place[f][b] for f, b in zip(leaf.features, leaf.low)], np.int32), np.array([place[f][b] for f, b in zip(leaf.features, leaf.high)], np.int32))
        for leaf in leaves
    ]
    return cuts, ends


def places_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """[feature, row]: how many bounds lie below a value; -1 if it is above none, not even -inf."""
    places = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.int32)
    places[~(x.T > -np.inf)] = -1
    return places


def batch_attributions(x: np.ndarray, leaves: list[PathLeaf], bounds: tuple | None = None) -> np.ndarray:
    """Attributions of the rows; ``bounds`` are the leaves' ``ranked_bounds``."""
    cuts, ends = bounds or ranked_bounds(leaves, x.shape[1])
    phi = np.zeros((x.shape[1], len(x)))
    places = places_of(x, cuts)
    for leaf, (low, high) in zip(leaves, ends):
        d = len(leaf.features)
        if not d or not len(x):
            continue
        code = np.zeros(len(x), np.int16 if d < 15 else np.int64)
        for i, f in enumerate(leaf.features):
            at = places[f]
            code |= ((at > low[i]) & (at <= high[i])).astype(code.dtype) << i
        seen, place = _distinct(code, d)
        patterns = ((seen[:, None] >> np.arange(d)) & 1).astype(float)
        values = pattern_values(leaf, patterns)
        for i, f in enumerate(leaf.features):
            phi[f] += values[:, i].take(place)
    return phi.T


def _distinct(code: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes below 2^d that occur, ascending, and each row's place among them."""
    if d > 12:
        return np.unique(code, return_inverse=True)
    there = np.zeros(1 << d, bool)
    there[code] = True
    return np.flatnonzero(there), (there.cumsum() - 1)[code]


def attributions(scaled: DataFrame, trees: Trees, features: list[str], averaged: bool) -> DataFrame:
    """Long form (customer_id, position, feature, phi) of every record; ``averaged`` for a
    forest (probability), else the sum of the trees (margin)."""
    leaves = path_leaves(trees, 1 / len(trees.feature) if averaged else 1.0)
    bounds = ranked_bounds(leaves, len(features))
    records = scaled.select(F.col("customer_id").cast("string"), *[F.col(c).cast("double").alias(c) for c in features])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in features]) if len(batch) else np.zeros((0, len(features)))
            phi = batch_attributions(np.ascontiguousarray(x), leaves, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("customer_id"), pa.FixedSizeListArray.from_arrays(pa.array(phi.ravel()), len(features)).cast(pa.list_(pa.float64()))],
                ["customer_id", "phi"],
            )

    names = F.array(*[F.lit(f) for f in features])
    return (
        records.mapInArrow(explain, "customer_id string, phi array<double>")
        .select("customer_id", F.posexplode("phi").alias("position", "phi"))
        .select("customer_id", "position", names[F.col("position")].alias("feature"), "phi")
    )
