"""Embedding near-dedup with product quantisation over coarse inverted lists.

Vectors are scaled to length one. A coarse centre per list and, for the rest of a vector
(its residual), one codeword per subspace are fitted on a bounded sample; every vector gets
its list, its code and the distance to what the code stands for. A query probes every list
that can hold a neighbour: one whose centre's half-space lies within the distance that the
least cosine allows. In a list, distances to all codes are sums of table lookups; members
whose distance less their own coding error is too large can't be linked, the others are
compared exactly, in double precision on the given vectors. Both tests are bounds, so no
link is lost and none below the threshold is counted.

Equal vectors of one label are one class, so copies are compared once and counted by their
number. Lists are kept per label and split into blocks of bounded size.

Nulls and ties: a null label and vectors that are null, zero, of another length than most or
hold null or non-finite components link with nothing; each is its own component. A repeated
row counts as another vector; rows of one vec_id with other vectors stay rows of their own, and
the id is one node, linked where any of them is. A null vec_id has no links. Other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.graph import components
from keepsake.llm.store import ship_package, written
from keepsake.llm.vectors import k_means, matrix, sample, soundness, squared_distances

#: Rows of the fitted sample; rows of a label in a list that are aimed at, and most lists;
#: subspaces and codewords of each.
SAMPLE, LIST_ROWS, MOST_LISTS, SUBSPACES, WORDS = 10_000, 1000, 256, 8, 256
#: Members and queries of a block.
BLOCK = 2000
#: Added to distances in single precision before a vector is left out.
SLACK = 1e-4


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class Quantiser:
    """Coarse centres and, per subspace, the codewords of the residuals."""

    def __init__(self, x: np.ndarray, lists: int):
        x = scaled(x)
        self.width = -(-x.shape[1] // SUBSPACES)
        self.centres = k_means(x, lists)
        rest = self._split(x - self.centres[squared_distances(x, self.centres).argmin(1)])
        self.words = [k_means(rest[:, m], WORDS, rounds=6) for m in range(SUBSPACES)]
        gaps = self.centres[:, None] - self.centres[None]
        self.gaps = np.sqrt((gaps * gaps).sum(2))

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, SUBSPACES * self.width - x.shape[1]))).reshape(len(x), SUBSPACES, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and coding error of vectors of length one."""
        own = squared_distances(x, self.centres).argmin(1)
        rest = self._split(x - self.centres[own])
        codes = np.stack([squared_distances(rest[:, m], w).argmin(1) for m, w in enumerate(self.words)], 1)
        miss = rest - np.stack([w[codes[:, m]] for m, w in enumerate(self.words)], 1)
        return own, codes.astype(np.uint8), np.sqrt((miss * miss).sum((1, 2)))

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """By vector: the lists that can hold a vector within ``reach``.

        A vector of list c is nearer to c than to any other centre, so it lies beyond the
        plane half-way between c and the query's own centre.
        """
        distances = squared_distances(x, self.centres)
        own = distances.argmin(1)
        beyond = distances - distances[np.arange(len(x)), own][:, None]
        near = beyond <= 2 * (reach + SLACK) * self.gaps[own]
        return [np.flatnonzero(row) for row in near]

    def distances(self, x: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Queries by members: distance to what the code stands for, from lookup tables."""
        rest = self._split(x - self.centres[list_])
        total = np.zeros((len(x), len(codes)), np.float32)
        for m, words in enumerate(self.words):
            total += squared_distances(rest[:, m], words).astype(np.float32)[:, codes[:, m]]
        return np.sqrt(total)


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked ids with the smallest id of their group, from pairs of places in ``ids``."""
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[a], low[b])
        now = low.copy()
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        now = now[now]
        if (now == low).all():
            break
        low = now
    moved = np.flatnonzero(low != np.arange(len(ids)))
    return ids[moved], ids[low[moved]]


def _coded(classes: DataFrame, quantiser: Quantiser, reach: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = scaled(matrix(batch.column("embedding")))
            own, codes, error = quantiser.encode(x)
            near = [row.tolist() for row in quantiser.probes(x, reach)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(near, pa.list_(pa.int64()))],
                [*batch.schema.names, "list", "code", "error", "probes"],
            )

    return classes.mapInArrow(
        run, "label int, vec_id long, embedding array<double>, copies long, list long, code binary, error double, probes array<long>"
    )


def links(classes: DataFrame, quantiser: Quantiser, least: float) -> DataFrame:
    """a, b, n: per query class ``a`` and block the copies ``n`` linked to it (b null), and
    stars (a, b) over the classes linked in the block (n null)."""
    reach = float(np.sqrt(2 - 2 * least))
    coded = written(_coded(classes, quantiser, reach), "coded-vectors")
    probing = coded.select("label", "vec_id", "embedding", F.explode("probes").alias("list"))
    members = coded.select("label", "list", "vec_id", "embedding", "copies", "code", "error")
    rows = members.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"))
    asks = probing.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    split = written(rows.join(asks, ["label", "list"]), "list-blocks")
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probing.join(split, ["label", "list"]).withColumn("chunk", own("qb")).withColumn("block", every("mb")).drop("mb", "qb")
    right = members.join(split, ["label", "list"]).withColumn("block", own("mb")).withColumn("chunk", every("qb")).drop("mb", "qb")

    def compare(key: tuple, asking: pd.DataFrame, rows_: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "n": []})
        if not len(asking) or not len(rows_):
            return none
        q, x = np.stack(asking.embedding), np.stack(rows_.embedding)
        near = quantiser.distances(scaled(q), int(key[1]), np.stack([np.frombuffer(c, np.uint8) for c in rows_.code]))
        i, j = np.nonzero(near <= reach + SLACK + rows_.error.to_numpy(np.float32)[None])
        lengths = [np.sqrt((v * v).sum(1)) for v in (q, x)]
        cosines = np.concatenate([
            (q[i[at : at + 65536]] * x[j[at : at + 65536]]).sum(1) / (lengths[0][i[at : at + 65536]] * lengths[1][j[at : at + 65536]])
            for at in range(0, len(i), 65536)
        ] or [np.zeros(0)])
        asked, ids = asking.vec_id.to_numpy(), rows_.vec_id.to_numpy()
        kept = (cosines >= least) & (asked[i] != ids[j])
        i, j = i[kept], j[kept]
        if not len(i):
            return none
        n = np.bincount(i, rows_.copies.to_numpy()[j], minlength=len(asked)).astype(np.int64)
        both = np.unique(np.concatenate([asked, ids]))
        a, b = stars(both, np.searchsorted(both, asked[i]), np.searchsorted(both, ids[j]))
        counted = n > 0
        return pd.concat([
            pd.DataFrame({"a": asked[counted], "b": None, "n": n[counted]}), pd.DataFrame({"a": a, "b": b, "n": None})
        ]).astype({"b": "Int64", "n": "Int64"})

    keys = ("label", "list", "chunk", "block")
    left, right = (side.toDF(*side.columns) for side in (left, right))  # columns of their own, as both come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long, n long")


def dedup(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. The fitted parts have a fixed size."""
    typed = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding")
    ship_package(vectors.sparkSession)
    takes_part = soundness(typed) & F.col("label").isNotNull()
    usable = typed.filter(takes_part)
    taking = usable.select("label", "vec_id", F.col("embedding").cast("array<double>"))
    classes = taking.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = written(classes.select("label", F.col("first").alias("vec_id"), "embedding", "copies"), "vector-classes")
    rows = classes.count()
    if not rows:
        return typed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    per_label = rows // classes.select("label").distinct().count()
    quantiser = Quantiser(sample(classes, rows, SAMPLE), int(min(MOST_LISTS, max(1, per_label // LIST_ROWS))))
    found = written(links(classes, quantiser, least), "vector-links")
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("linked"))
    groups = components(found.filter("b is not null").select("a", "b"), "vector-groups")
    of_class = (
        classes.join(counts, F.col("vec_id") == F.col("a"), "left").join(groups, F.col("vec_id") == F.col("node"), "left")
        .select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    joined = taking.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = typed.filter(~takes_part).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return joined.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
