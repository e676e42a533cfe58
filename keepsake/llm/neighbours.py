"""Nearest neighbours by inner product, with a hierarchical k-means tree.

Each vector gets one more component, ``sqrt(largest squared norm - own squared norm)``, and
a query a zero: the largest inner product is then the smallest distance. The tree is fitted
on a bounded sample; every vector is routed to a leaf. A query goes down best bin first: a
priority queue holds the nodes met so far by the distance to their centres, and leaves are
taken from it until a number of visits. That number is widened on a set of calibration
queries, whose true neighbours come from comparing them with all rows, until their mean
recall reaches TARGET. A query whose visited leaves do not hold k rows besides those of its
own id goes on to further leaves, so it gets fewer than k only if there are fewer.

Leaves that stand next to each other in the tree form bins of about BIN rows. A query goes
once to each bin it visits, with the list of its leaves there. Bins with more rows and bins
with many queries are split into blocks, so neither a frequent vector nor a frequented bin
gathers in one task.

Nulls and ties: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; equal products go to the smaller vec_id; equal vectors
have equal products, as every product is summed in the same order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.store import ship_package, spread_parts, written
from keepsake.llm.vectors import k_means, matrix, sample, squared_distances, valid

SAMPLE, FAN = 20_000, 8
#: Rows of a leaf and of a bin that are aimed at; rows and queries of a block.
LEAF, BIN, BLOCK = 64, 6000, 8000
CALIBRATION, TARGET, WIDEN = 100, 0.96, 1.25


class Tree:
    """Centres of a hierarchical k-means tree; leaves are numbered from left to right."""

    def __init__(self, x: np.ndarray, leaf_rows: float):
        self.kids: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        self.root = self._grow(x, max(leaf_rows, 2), 0)
        self.own = np.zeros((len(self.kids), x.shape[1]))  # each node's own centre
        for node, kids in enumerate(self.kids):
            self.own[kids] = self.centres[node]

    def _grow(self, x: np.ndarray, leaf_rows: float, depth: int) -> int:
        node = len(self.kids)
        self.kids.append([])
        self.centres.append(np.zeros((0, x.shape[1])))
        self.leaf.append(-1)
        centres = k_means(x, FAN, seed=node) if len(x) > leaf_rows and depth < 24 else x[:0]
        if len(centres) < 2:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node
        nearest = squared_distances(x, centres).argmin(1)
        self.centres[node] = centres
        self.kids[node] = [self._grow(x[nearest == k], leaf_rows, depth + 1) for k in range(len(centres))]
        return node

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        waiting = [(self.root, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = squared_distances(x[rows], self.centres[node]).argmin(1)
                waiting += [(kid, rows[nearest == k]) for k, kid in enumerate(self.kids[node])]
        return out

    def gaps(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the centres of all nodes."""
        return squared_distances(queries, self.own)

    def visits(self, gaps: list[float], least: int, held: list[int] | None = None, needed: int = 0) -> list[int]:
        """Leaves in best-bin-first order, by a query's ``gaps``: ``least`` of them, and more
        until they hold ``needed`` rows, by the rows ``held`` in each leaf."""
        queue, found, rows = [(0.0, self.root)], [], 0
        pop, push, leaf_of, kids_of = heapq.heappop, heapq.heappush, self.leaf, self.kids
        while queue and (len(found) < least or rows < needed):
            _, node = pop(queue)
            leaf = leaf_of[node]
            if leaf >= 0:
                found.append(leaf)
                rows += held[leaf] if held else 0
            else:
                for kid in kids_of[node]:
                    push(queue, (gaps[kid], kid))
        return found


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm - (x * x).sum(1), 0))[:, None]])


def lifted_query(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), 1))])


def best(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, at: np.ndarray, products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows ``at`` for one query: ids and exact products, best first."""
    others = ids[at] != own
    usable, products = at[others], products[others]
    if len(usable) > k:
        # equal vectors may differ in the last bits of the matrix product
        least = np.partition(products, len(usable) - k)[len(usable) - k]
        usable = usable[products >= least - 1e-9 * max(1.0, abs(least))]
    exact = (x[usable] * query).sum(1)
    order = np.lexsort((ids[usable], -exact))[:k]
    return ids[usable][order], exact[order]


def _index(vectors: DataFrame, tree: Tree, norm: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(lifted(matrix(batch.column("embedding")), norm))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf)], ["vec_id", "embedding", "leaf"])

    typed = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return typed.mapInArrow(run, "vec_id long, embedding array<double>, leaf long")


def true_leaves(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, leaf of the true k nearest rows of a bounded set of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(False)
            leaf, products = dict(zip(own.tolist(), batch.column("leaf").to_pylist())), queries @ x.T
            out = []
            for i in range(len(ids)):
                found, score = best(queries[i], ids[i], own, x, np.arange(len(own)), products[i], k)
                out += [(int(ids[i]), int(v), float(s), leaf[v]) for v, s in zip(found.tolist(), score)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                ["query_id", "vec_id", "score", "leaf"],
            )

    rows = index.mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "leaf")


def calibrated_visits(tree: Tree, index: DataFrame, queries: DataFrame, k: int) -> int:
    """Leaf visits at which the calibration queries reach TARGET."""
    chosen = queries.orderBy(F.xxhash64("vec_id", F.lit("calibration")), "vec_id").limit(CALIBRATION).collect()
    if not chosen:
        return 1
    ids, x = np.array([r.vec_id for r in chosen]), np.array([r.embedding for r in chosen], float)
    orders = {
        i: {leaf: n for n, leaf in enumerate(tree.visits(row, tree.n_leaves))} for i, row in zip(ids.tolist(), tree.gaps(lifted_query(x)).tolist())
    }
    places = np.array([orders[r.query_id][r.leaf] for r in true_leaves(index, ids, x, k).collect()])
    visits = 1
    while visits < tree.n_leaves and (places < visits).mean() < TARGET:
        visits = min(tree.n_leaves, int(visits * WIDEN) + 1)
    return visits


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` nearest to each row of
    ``queries`` (both vec_id, embedding), other than the query's own.

    Rows of ``queries`` that are equal are one query; rows of one vec_id with other vectors are
    queries of their own under that id. Every row of ``vectors`` is a candidate, repeated ones
    too. Other columns are ignored; without vectors or queries there is no row. The tree has at most SAMPLE / 2 leaves, so tasks may hold it and the rows of each leaf.
    """
    ship_package(vectors.sparkSession)
    usable = valid(vectors)
    asked = valid(queries).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).distinct()
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)
    rows, norm = usable.agg(F.count("*"), F.max(square)).first()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = lifted(sample(usable, rows, SAMPLE), norm)
    tree = Tree(fitted, max(LEAF * len(fitted) / rows, 4))
    index = written(_index(usable, tree, norm), "tree-index")
    visits = calibrated_visits(tree, index, asked, k)
    per_bin = max(1, round(BIN / max(rows / tree.n_leaves, 1)))
    held = np.zeros(tree.n_leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        held[r.leaf] = r.n
    # rows of the query's own id are no candidates; an id that is not repeated counts one
    repeated = index.groupBy(F.col("vec_id").alias("own_id")).agg(F.count("*").alias("own")).filter("own > 1")
    asked = asked.join(repeated, F.col("vec_id") == F.col("own_id"), "left").select("vec_id", "embedding", F.coalesce("own", F.lit(1)).alias("own"))
    # dealt by another expression than the join's key: else the join's few partitions would stay
    asked = asked.repartition(spread_parts(vectors.sparkSession, rows, 8 * BLOCK), F.xxhash64("vec_id", F.lit("deal")))
    rows_held = held.tolist()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, own, out = batch.column("vec_id").to_pylist(), matrix(batch.column("embedding")), batch.column("own").to_pylist(), []
            for begin in range(0, len(ids), 200):
                part = slice(begin, begin + 200)
                for i, q, n, gaps in zip(ids[part], x[part], own[part], tree.gaps(lifted_query(x[part])).tolist()):
                    bins: dict[int, list[int]] = {}
                    for leaf in tree.visits(gaps, visits, rows_held, k + n):
                        bins.setdefault(leaf // per_bin, []).append(leaf)
                    out += [(i, q, b, sorted(leaves)) for b, leaves in bins.items()]
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ([],) * 4, kinds)], ["query_id", "query", "bin", "leaves"])

    sent = written(asked.mapInArrow(go, "query_id long, query array<double>, bin long, leaves array<long>"), "tree-visits")
    members = index.withColumn("bin", F.floor(F.col("leaf") / per_bin))
    blocks = members.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"))
    chunks = sent.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    split = blocks.join(chunks, "bin")
    # hash-dealt blocks: a member goes to one block of rows and all chunks of queries, a query the other way round
    left = sent.join(split, "bin").select(
        "bin", "query_id", F.xxhash64("query").alias("tag"), "query", "leaves", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("block"),
    )
    right = members.join(split, "bin").select(
        "bin", "vec_id", "embedding", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("mb")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("chunk"),
    )

    def score(asking: pd.DataFrame, rows_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(rows_):
            rows_ = rows_.sort_values("leaf", kind="stable")
            x, ids, leaf = np.stack(rows_.embedding), rows_.vec_id.to_numpy(), rows_.leaf.to_numpy()
            asked_x = np.stack(asking["query"])
            names, tags, visited = asking.query_id.tolist(), asking.tag.tolist(), asking.leaves.tolist()
            for begin in range(0, len(names), 200):
                products = asked_x[begin : begin + 200] @ x.T
                for n in range(begin, min(begin + 200, len(names))):
                    ends = np.searchsorted(leaf, np.stack([visited[n], visited[n] + 1]), "left")
                    sizes = ends[1] - ends[0]
                    at = np.repeat(ends[0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    found, value = best(asked_x[n], names[n], ids, x, at, products[n - begin, at], k)
                    out += [(names[n], tags[n], v, s) for v, s in zip(found, value)]
        kinds = {"query_id": "int64", "tag": "int64", "vec_id": "int64", "score": "float64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    keys = ("bin", "chunk", "block")
    left, right = (side.toDF(*side.columns) for side in (left, right))  # columns of their own, as both meet the same counts
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query_id long, tag long, vec_id long, score double")
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
