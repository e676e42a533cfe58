"""Vectors that take part in a search or join, and k-means on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def soundness(vectors: DataFrame) -> Column:
    """Whether a row's embedding has the table's usual length, finite components and not only
    zeros, and the row a vec_id; never null."""
    x = F.col("embedding")
    sound = x.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    sound = F.coalesce(F.col("vec_id").isNotNull() & sound & F.exists(x, lambda v: v != 0), F.lit(False))
    kept = vectors.filter(sound)
    usual = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return sound & F.coalesce(F.size("embedding") == (usual.n if usual else 0), F.lit(False))


def valid(vectors: DataFrame) -> DataFrame:
    """The rows that take part."""
    return vectors.filter(soundness(vectors))


def sample(vectors: DataFrame, rows: int, most: int) -> np.ndarray:
    """At most ``most`` embeddings, chosen by a hash of vec_id."""
    share = min(1.0, most / max(rows, 1))
    chosen = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit("vectors")), F.lit(1_000_000)) < share * 1_000_000)
    found = chosen.select("vec_id", "embedding").orderBy("vec_id").limit(most).collect()
    return np.array([r.embedding for r in found], float)


def matrix(column, kind=np.float64) -> np.ndarray:
    """An Arrow list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centres of the distinct rows; empty centres are dropped."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        nearest = squared_distances(x, centres).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = sums[counts > 0] / counts[counts > 0, None]
    return centres
