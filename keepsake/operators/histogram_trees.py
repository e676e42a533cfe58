"""Second-order boosted trees, forests and Newton regressions of many models in shared passes.

Training rows carry the number of the model they train (a fold, or the only model). They are
packed into blocks of bounded size: binned features, labels and row hashes. A pass sums
histograms of (model, node, feature, bin) over the blocks, partial sums are combined by key
before anything reaches the driver, and only the best split of every node is returned; all
models share each pass, one per tree level or Newton step.

A model of at most WHOLE_ROWS rows is one block and needs no sums across tasks: there the same
growing code runs inside one task on that block, all its levels at once, and models (and groups
of a forest's trees) are dealt to tasks. Trees need the bins alone, an eighth of the values, so a
task grows them on models of up to TREE_ROWS rows, whose blocks it is sent. Both ways give equal
trees (tested); WHOLE_ROWS and TREE_ROWS bound the memory of the one way, BLOCK_ROWS that of the other.

Randomness comes from hashes of row, model, tree and node, so a repeated task gives the same
trees. Margins of finished rounds are remembered per worker and block; a worker that has none
computes them from the trees it is sent.

* Boosting: gradient and hessian of the log loss, leaf values -eta * G / (H + l2), rows and
  columns sampled per tree, `min_child` as the least hessian of a child.
* Forest: Poisson bootstrap, features drawn per node, Gini impurity on weighted rows. A node is
  split only if it holds `min_split` rows and either child `min_leaf`, counting drawn rows once.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

#: Rows of a block, of a model that is one block, and most bins of a feature.
BLOCK_ROWS, WHOLE_ROWS, BINS = 50_000, 200_000, 64
#: Rows of a model whose trees one task grows: about 200 bytes of the task's memory for each.
TREE_ROWS = 1_500_000
#: Bytes of histograms that one pass asks for, and partial results that are combined per step.
PASS_BYTES, COMBINED = 64 << 20, 32
#: Trees of a forest that one task grows: of a model that is one block, and of one sent as several.
TREES_PER_TASK, TREES_OF_BLOCKS = 10, 25

BLOCKS = "model int, block string, n int, ids binary, y binary, x binary, bins binary"


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A reproducible number in [0, 1) per id."""
    x = ids.astype(np.uint64)
    for s in salt:
        x = (x ^ np.uint64(s * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def drawn(n: int, k: int, *salt: int) -> np.ndarray:
    """k of n numbers, ascending, by hash."""
    return np.sort(np.argsort(uniform(np.arange(n), *salt), kind="stable")[:k])


@dataclass
class Trees:
    """Binary trees in heap order (children of i are 2i+1 and 2i+2); feature -1 marks a leaf.
    A row goes left if its value is at most the threshold."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        shape = (trees, (2 << depth) - 1)
        return cls(
            np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int64)
        )

    def part(self, begin: int, end: int) -> Trees:
        return Trees(*(a[begin:end] for a in vars(self).values()))

    def join(self, other: Trees) -> Trees:
        return Trees(*(np.concatenate(pair) for pair in zip(vars(self).values(), vars(other).values())))

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    def below(self, tree: int, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """One step down from the nodes where the rows of bins are; those at a leaf stay."""
        feature = self.feature[tree, at]
        right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.bin[tree, at]
        return np.where(feature >= 0, 2 * at + 1 + right, at)

    def nodes_of(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node where each row of bins ends."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(self.depth):
            if not (self.feature[tree, at] >= 0).any():
                break
            at = self.below(tree, at, bins)
        return at

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of all trees' values for rows of real features."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for tree in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = self.feature[tree, at]
                inner = feature >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (x[row, np.maximum(feature, 0)] > self.threshold[tree, at]), at)
            total += self.value[tree, at]
        return total


@dataclass
class Block:
    """Rows of one model in memory."""

    model: int
    name: str
    ids: np.ndarray
    y: np.ndarray
    x: np.ndarray
    bins: np.ndarray


@dataclass(frozen=True)
class Boosting:
    rounds: int = 200
    depth: int = 6
    eta: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    min_child: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Forest:
    trees: int = 200
    depth: int = 10
    min_split: int = 5
    min_leaf: int = 2
    seed: int = 42

    def columns(self, features: int) -> int:
        return max(1, int(np.sqrt(features)))


@dataclass(frozen=True)
class Newton:
    """Logistic regression with balanced class weights; C as in summed loss + |w|^2 / 2C."""

    c: float = 1.0
    steps: int = 100
    tolerance: float = 1e-10


# --- histograms of one block ------------------------------------------------------------------


def boost_sample(block: Block, margins: np.ndarray, at: int, p: Boosting, heavy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows drawn for a tree, their gradients and hessians."""
    odds = 1 / (1 + np.exp(-margins))
    weight = np.where(block.y == 1, heavy, 1.0)
    g, h = (odds - block.y) * weight, np.maximum(odds * (1 - odds), 1e-16) * weight
    drawn_rows = np.flatnonzero(uniform(block.ids, p.seed, block.model, at) < p.rows)
    return drawn_rows, g[drawn_rows], h[drawn_rows]


def boost_histogram(bins: np.ndarray, ends: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: np.ndarray, places: int) -> np.ndarray:
    """[node, column, bin, (gradient, hessian, rows)] of drawn rows at ``nodes``, of the ``places``
    of a tree. ``bins`` has a line per column; ``ends`` are the nodes where the rows are."""
    place = np.full(places, -1)
    place[nodes] = np.arange(len(nodes))
    local = place[ends]
    kept = np.flatnonzero(local >= 0)
    if len(kept) < len(local):
        local, g, h, bins = local[kept], g[kept], h[kept], bins[:, kept]
    local, size = local * BINS, len(nodes) * BINS
    out = np.empty((len(nodes), len(bins), BINS, 3))
    for i, line in enumerate(bins):
        codes = local + line
        for j, weights in enumerate((g, h, None)):
            out[:, i, :, j] = np.bincount(codes, weights, minlength=size).reshape(len(nodes), BINS)
    return out


def packed_lines(bins: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """The columns of ``bins``, those of few values several to a line as digits of one number below
    BINS: the lines, and of every line its columns with their digits' unit and number of values."""
    groups, sizes = [], []
    for column in sorted(range(len(edges)), key=lambda i: len(edges[i])):
        values = len(edges[column]) + 1
        if not groups or sizes[-1] * values > BINS:
            groups.append([])
            sizes.append(1)
        groups[-1].append((column, sizes[-1], values))
        sizes[-1] *= values
    lines = np.zeros((len(groups), len(bins)), np.uint8)
    for line, group in zip(lines, groups):
        for column, unit, _ in group:
            line += bins[:, column] * np.uint8(unit)
    return lines, groups


def packed_histogram(lines: list[np.ndarray], groups: list, columns: np.ndarray, local: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """What `boost_histogram` gives but the rows, which are 0, of drawn rows that stand at the nodes
    ``local``, from a count per line: a column's sums are those over the other digits."""
    place = {int(c): i for i, c in enumerate(columns)}
    at, size = local * BINS, nodes * BINS
    out = np.zeros((nodes, len(columns), BINS, 3))
    for line, group in zip(lines, groups):
        if not any(c in place for c, _, _ in group):
            continue
        codes = at + line
        for j, weights in enumerate((g, h)):
            sums = np.bincount(codes, weights, minlength=size).reshape(nodes, BINS)
            for c, unit, values in group:
                if c in place:
                    used = sums[:, : BINS // (unit * values) * unit * values].reshape(nodes, -1, values, unit)
                    out[:, place[c], :values, j] = used.sum(axis=(1, 3))
    return out


def forest_sample(block: Block, number: int, p: Forest, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in tree ``number``'s bootstrap, their weights, and these where the label is 1."""
    u, times, below = uniform(block.ids, p.seed, block.model, number), np.zeros(len(block.ids)), np.exp(-1.0)
    limit, k = below, 0
    while k < 12 and (over := u >= limit).any():
        times += over
        k += 1
        below /= k
        limit += below
    rows = np.flatnonzero(times)
    w = times[rows] * np.where(block.y[rows] == 1, weights[1], weights[0])
    return rows, w, w * block.y[rows]


def forest_histogram(bins: np.ndarray, ends: np.ndarray, w: np.ndarray, positive: np.ndarray, nodes: np.ndarray, columns: np.ndarray, places: int) -> np.ndarray:
    """[node, column, bin, (weight, weight of positives, rows)] of a bootstrap's rows at ``nodes``,
    of the ``places`` of a tree. ``ends`` are the nodes where the rows are."""
    place = np.full(places, -1)
    place[nodes] = np.arange(len(nodes))
    local = place[ends]
    kept = np.flatnonzero(local >= 0)
    if len(kept) < len(local):
        local, w, positive, bins = local[kept], w[kept], positive[kept], bins[kept]
    row, size = np.arange(len(w)), len(nodes) * BINS
    out = np.empty((len(nodes), columns.shape[1], BINS, 3))
    for i in range(columns.shape[1]):
        codes = local * BINS + bins[row, columns[local, i]]
        for j, weights in enumerate((w, positive, None)):
            out[:, i, :, j] = np.bincount(codes, weights, minlength=size).reshape(len(nodes), BINS)
    return out


# --- splits -----------------------------------------------------------------------------------


def boost_splits(h: np.ndarray, p: Boosting) -> tuple[np.ndarray, ...]:
    """Per node: best gain, column place, bin, sums of the left side, sums of all."""
    left = h.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + p.l2)
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < p.min_child) | (right[..., 1] < p.min_child)] = -np.inf
    return _best(gain, left, total, 1e-6)


def forest_splits(h: np.ndarray, p: Forest) -> tuple[np.ndarray, ...]:
    left = h.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    # Weighted Gini decrease times the node's weight, up to a constant.
    pure = lambda s: (s[..., 1] ** 2 + (s[..., 0] - s[..., 1]) ** 2) / np.maximum(s[..., 0], 1e-300)
    gain = pure(left) + pure(right) - pure(total)
    gain[(left[..., 2] < p.min_leaf) | (right[..., 2] < p.min_leaf) | (total[..., 2] < p.min_split)] = -np.inf
    return _best(gain, left, total, 1e-9)


def _best(gain: np.ndarray, left: np.ndarray, total: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    flat = np.round(gain.reshape(len(gain), -1), 9)  # sums in another order are the same split
    best = flat.argmax(axis=1)
    column, cut = np.divmod(best, gain.shape[2])
    node = np.arange(len(gain))
    return flat[node, best] > least, column, cut, left[node, column, cut], total[:, 0, 0]


def set_splits(trees: Trees, at: int, nodes: np.ndarray, columns: np.ndarray, found: tuple, edges: list[np.ndarray], value: Callable, weight: int) -> np.ndarray:
    """Write what was found for the nodes of one level; returns the children to look at next.
    ``weight`` is the sum that a node's cover is: the hessian, or the weight of its rows."""
    good, column, cut, left, total = found
    trees.value[at, nodes], trees.cover[at, nodes], trees.rows[at, nodes] = value(total), total[:, weight], np.round(total[:, 2])
    split = nodes[good]
    if not len(split):
        return split
    chosen = columns[column[good]] if columns.ndim == 1 else columns[np.flatnonzero(good), column[good]]
    trees.feature[at, split], trees.bin[at, split] = chosen, cut[good]
    trees.threshold[at, split] = [edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(chosen, cut[good])]
    for child, sums in ((2 * split + 1, left[good]), (2 * split + 2, (total - left)[good])):
        trees.value[at, child], trees.cover[at, child], trees.rows[at, child] = value(sums), sums[:, weight], np.round(sums[:, 2])
    return np.sort(np.concatenate([2 * split + 1, 2 * split + 2]))


# --- growing: the same steps on one block or over all -------------------------------------------


@dataclass
class Shape:
    """What all tasks know of a model: label counts and bin edges."""

    counts: tuple[int, int]
    edges: list[np.ndarray]

    @property
    def heavy(self) -> float:
        return self.counts[0] / max(self.counts[1], 1)

    @property
    def balanced(self) -> tuple[float, float]:
        n = sum(self.counts)
        return n / (2 * max(self.counts[0], 1)), n / (2 * max(self.counts[1], 1))


def boost_value(p: Boosting) -> Callable:
    return lambda s: -p.eta * s[:, 0] / (s[:, 1] + p.l2)


def boost_columns(p: Boosting, features: int, model: int, at: int) -> np.ndarray:
    return drawn(features, max(1, int(p.columns * features)), p.seed, model, at, 1)


def forest_value(s: np.ndarray) -> np.ndarray:
    return s[:, 1] / np.maximum(s[:, 0], 1e-300)


def forest_columns(p: Forest, features: int, model: int, number: int, nodes: np.ndarray) -> np.ndarray:
    return np.array([drawn(features, p.columns(features), p.seed, model, number, int(n), 2) for n in nodes], np.int64).reshape(len(nodes), -1)


def boost_in_block(block: Block, shape: Shape, p: Boosting) -> Trees:
    """Of two children only the one with fewer rows is counted: the other's sums are what is left."""
    trees, margins = Trees.empty(p.rounds, p.depth), np.zeros(len(block.y))
    lines, groups = packed_lines(block.bins, shape.edges)
    places = trees.feature.shape[1]
    for at in range(p.rounds):
        nodes, columns = np.zeros(1, np.int64), boost_columns(p, block.bins.shape[1], block.model, at)
        rows, g, h = boost_sample(block, margins, at, p, shape.heavy)
        own, ends = [line[rows] for line in lines], np.zeros(len(block.y), np.int64)
        sums = packed_histogram(own, groups, columns, ends[rows], g, h, 1)
        for level in range(p.depth):
            found = boost_splits(sums, p)
            parents = sums[found[0]]
            nodes = set_splits(trees, at, nodes, columns, found, shape.edges, boost_value(p), 1)
            ends = trees.below(at, ends, block.bins) if len(nodes) else ends
            here = ends[rows]
            counts = np.bincount(here, minlength=places)
            if not len(nodes) or level + 1 == p.depth:
                break
            pairs = nodes.reshape(-1, 2)
            few = (counts[pairs[:, 1]] < counts[pairs[:, 0]]).astype(np.int64)
            place = np.full(places, -1)
            place[pairs[np.arange(len(pairs)), few]] = np.arange(len(pairs))
            local = place[here]
            kept = np.flatnonzero(local >= 0)
            counted = packed_histogram([line[kept] for line in own], groups, columns, local[kept], g[kept], h[kept], len(pairs))
            sums = np.empty((len(pairs), 2, *counted.shape[1:]))
            sums[np.arange(len(pairs)), few], sums[np.arange(len(pairs)), 1 - few] = counted, parents - counted
            sums = sums.reshape(len(nodes), *counted.shape[1:])
        for node in reversed(np.flatnonzero(trees.feature[at] >= 0)):
            counts[node] += counts[2 * node + 1] + counts[2 * node + 2]
        trees.rows[at] = counts
        margins += trees.value[at, ends]
    return trees


def forest_in_block(block: Block, shape: Shape, p: Forest, begin: int, end: int) -> Trees:
    trees = Trees.empty(end - begin, p.depth)
    for at in range(end - begin):
        nodes = np.zeros(1, np.int64)
        rows, w, positive = forest_sample(block, begin + at, p, shape.balanced)
        bins, ends = block.bins[rows], np.zeros(len(rows), np.int64)
        for _ in range(p.depth):
            columns = forest_columns(p, block.bins.shape[1], block.model, begin + at, nodes)
            found = forest_splits(forest_histogram(bins, ends, w, positive, nodes, columns, trees.feature.shape[1]), p)
            nodes = set_splits(trees, at, nodes, columns, found, shape.edges, forest_value, 0)
            if not len(nodes):
                break
            ends = trees.below(at, ends, bins)
    return trees


def newton_sums(block: Block, w: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """Gradient, hessian and loss of the summed weighted log loss, in one row."""
    x = np.hstack([block.x, np.ones((len(block.x), 1))])
    z = x @ w
    odds, weight = 1 / (1 + np.exp(-z)), np.where(block.y == 1, weights[1], weights[0])
    g, h = (odds - block.y) * weight, odds * (1 - odds) * weight
    loss = (weight * (np.logaddexp(0, z) - block.y * z)).sum()
    return np.concatenate([x.T @ g, (x.T * h @ x).ravel(), [loss]])


def newton_step(w: np.ndarray, sums: np.ndarray, p: Newton) -> tuple[np.ndarray, float]:
    n = len(w)
    ridge = np.append(np.full(n - 1, 1 / p.c), 0.0)  # the intercept is free
    gradient, hessian = sums[:n] + ridge * w, sums[n : n + n * n].reshape(n, n) + np.diag(ridge + 1e-12)
    move = np.linalg.solve(hessian, gradient)
    return w - move, float(gradient @ move) / 2


# --- Spark --------------------------------------------------------------------------------------


def edges_of(frame: DataFrame, features: list[str], bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """By model and feature: ascending upper ends of the bins but the last, from quantiles."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = frame.groupBy("model").agg(*[F.percentile_approx(c, at, 10_000).alias(f"q_{c}") for c in features])
    return {r["model"]: [np.unique(np.array(r[f"q_{c}"] or [], float)) for c in features] for r in rows.collect()}  # a row per model


class Training:
    """Blocks of the training rows of all models. ``frame`` has model, customer_id, churn (0 or 1)
    and the features, which are not null."""

    def __init__(self, frame: DataFrame, features: list[str], block_rows: int | None = None):
        self.features = list(features)
        self.spark = frame.sparkSession
        frame = frame.filter("churn is not null")
        edges = edges_of(frame, features)
        counts = {(r["model"], int(r["churn"])): r["n"] for r in frame.groupBy("model", "churn").agg(F.count("*").alias("n")).collect()}
        self.shapes = {m: Shape((counts.get((m, 0), 0), counts.get((m, 1), 0)), e) for m, e in edges.items()}
        whole = block_rows or WHOLE_ROWS
        blocks = {m: 1 if sum(s.counts) <= whole else -(-sum(s.counts) // (block_rows or BLOCK_ROWS)) for m, s in self.shapes.items()}
        self.blocks = stored(self._packed(frame, edges, blocks)).persist()
        held = self.blocks.groupBy("model").agg(F.count("*").alias("blocks")).collect()
        self.split = {r["model"]: r["blocks"] for r in held}
        self.most = block_rows or TREE_ROWS

    def release(self) -> None:
        self.blocks.unpersist()

    def _packed(self, frame: DataFrame, edges: dict, blocks: dict[int, int]) -> DataFrame:
        """Each model's rows dealt by hash into enough parts, each part a block."""
        features = self.features
        parts = F.coalesce(*[F.when(F.col("model") == m, n) for m, n in blocks.items()], F.lit(1))
        key = F.xxhash64("customer_id")
        dealt = frame.select(
            F.col("model").cast("int"), key.alias("id"), F.col("churn").cast("double").alias("y"), F.pmod(F.xxhash64("customer_id", F.lit("block")), parts).alias("part"),
            *[F.col(c).cast("double").alias(c) for c in features],
        )

        def pack(batch: pa.Table) -> pa.Table:
            model = batch.column("model")[0].as_py()
            order = np.argsort(batch.column("id").to_numpy(), kind="stable")
            x = np.column_stack([batch.column(c).to_numpy() for c in features])[order]
            bins = np.column_stack([np.searchsorted(edges[model][i], x[:, i], "left") for i in range(len(features))]).astype(np.uint8)
            ids, y = batch.column("id").to_numpy()[order].view(np.uint64), batch.column("y").to_numpy()[order]
            name = f"{model}-{batch.column('part')[0].as_py()}"
            return pa.table({
                "model": pa.array([model], pa.int32()), "block": [name], "n": pa.array([len(y)], pa.int32()), "ids": [ids.tobytes()],
                "y": [y.tobytes()], "x": [np.ascontiguousarray(x).tobytes()], "bins": [bins.tobytes()],
            })

        return dealt.groupBy("model", "part").applyInArrow(pack, BLOCKS)

    def _blocks(self, p: Boosting | Forest | Newton) -> DataFrame:
        """The blocks; trees need the bins alone, which are an eighth of the values."""
        return self.blocks if isinstance(p, Newton) else self.blocks.withColumn("x", F.lit(b""))

    def _whole(self, p: Boosting | Forest | Newton) -> list[int]:
        """Models that grow inside tasks; the others are summed over the tasks."""
        fits = lambda m: not isinstance(p, Newton) and sum(self.shapes[m].counts) <= self.most
        return sorted(m for m, n in self.split.items() if n == 1 or fits(m))

    def _spread(self, p: Boosting | Forest | Newton) -> list[int]:
        return sorted(set(self.split) - set(self._whole(p)))

    def grow(self, p: Boosting | Forest | Newton) -> dict[int, Trees | np.ndarray]:
        """The fitted trees (or weights, the intercept last) of every model."""
        found = self._grown_in_tasks(p)
        spread = self._spread(p)
        if spread:
            found |= {Boosting: self._boost, Forest: self._forest, Newton: self._newton}[type(p)](p, spread)
        return found

    def _grown_in_tasks(self, p) -> dict:
        width, shapes = len(self.features), self.shapes
        whole = self._whole(p)
        if not whole:
            return {}
        each = {m: TREES_PER_TASK if n == 1 else TREES_OF_BLOCKS for m, n in self.split.items()}
        begins = {m: list(range(0, p.trees, each[m])) if isinstance(p, Forest) else [0] for m in whole}
        first = dict(zip(whole, [0, *np.cumsum([len(b) for b in begins.values()]).tolist()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, begin = [], 0
            for batch in batches:  # of one model, with one begin
                blocks += [read_block(batch, i, width) for i in range(len(batch))]
                begin = batch.column("begin")[0].as_py() if len(batch) else begin
            if not blocks:
                return
            block = joined(blocks)
            shape = shapes[block.model]
            if isinstance(p, Newton):
                w, left = np.zeros(width + 1), np.inf
                for _ in range(p.steps):
                    w, left = newton_step(w, newton_sums(block, w, shape.balanced), p)
                    if left < p.tolerance:
                        break
                made = [w]
            elif isinstance(p, Boosting):
                made = list(vars(boost_in_block(block, shape, p)).values())
            else:
                made = list(vars(forest_in_block(block, shape, p, begin, min(begin + each[block.model], p.trees))).values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.model], pa.int32()), pa.array([begin], pa.int32()), pa.array([[a.tobytes() for a in made]], pa.list_(pa.binary()))],
                ["model", "begin", "made"],
            )

        turn = F.posexplode(F.coalesce(*[F.when(F.col("model") == m, F.array(*map(F.lit, b))) for m, b in begins.items()])).alias("turn", "begin")
        task = F.coalesce(*[F.when(F.col("model") == m, n) for m, n in first.items()]) + F.col("turn")
        blocks = self._blocks(p).filter(F.col("model").isin(whole)).select("*", turn).withColumn("task", task.cast("int"))
        dealt = blocks.repartitionById(sum(map(len, begins.values())), "task").sortWithinPartitions("block").drop("turn", "task")
        rows = sorted(dealt.mapInArrow(run, "model int, begin int, made array<binary>").collect(), key=lambda r: (r["model"], r["begin"]))
        found: dict = {}
        for r in rows:  # bounded by the models: trees x nodes
            if isinstance(p, Newton):
                found[r["model"]] = np.frombuffer(r["made"][0], float)
                continue
            n = p.rounds if isinstance(p, Boosting) else min(each[r["model"]], p.trees - r["begin"])
            empty = Trees.empty(n, p.depth)
            trees = Trees(*(np.frombuffer(b, a.dtype).reshape(a.shape).copy() for b, a in zip(r["made"], vars(empty).values())))
            found[r["model"]] = found[r["model"]].join(trees) if r["model"] in found else trees
        return found

    def _summed(self, work: Callable, p: Boosting | Forest | Newton) -> DataFrame:
        """Sums of what ``work(block)`` yields as (tree, node, array), by (model, tree, node):
        added within a task, then by groups of tasks, then by key."""
        width, spread = len(self.features), self._spread(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for batch in batches:
                for i in range(len(batch)):
                    block = read_block(batch, i, width)
                    for tree, node, array in work(block):
                        key = (block.model, tree, node)
                        sums[key] = sums[key] + array if key in sums else array
            yield from summed_rows(sums)

        parts = self._blocks(p).filter(F.col("model").isin(spread)).mapInArrow(run, SUMS)
        if max(self.split.values()) > COMBINED:
            parts = combined(parts.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(COMBINED))), ["model", "tree", "node", "salt"])
        return combined(parts, ["model", "tree", "node"])

    def _boost(self, p: Boosting, models: list[int]) -> dict[int, Trees]:
        trees = {m: Trees.empty(p.rounds, p.depth) for m in models}
        width, run_id, shapes = len(self.features), uuid.uuid4().hex, self.shapes
        for at in range(p.rounds):
            nodes = {m: np.zeros(1, np.int64) for m in models}
            columns = {m: boost_columns(p, width, m, at) for m in models}
            sent = {m: trees[m].part(0, at + 1) for m in models}
            for _ in range(p.depth):
                asked = {m: n for m, n in nodes.items() if len(n)}
                if not asked:
                    break

                def work(block: Block, at=at, asked=asked, columns=columns, sent=sent) -> Iterator:
                    if block.model in asked:
                        own, n = sent[block.model], asked[block.model]
                        margins = remembered_margins(run_id, block, own, at)
                        rows, g, h = boost_sample(block, margins, at, p, shapes[block.model].heavy)
                        lines, ends = block.bins.T[columns[block.model]][:, rows], own.nodes_of(at, block.bins)[rows]
                        h = boost_histogram(lines, ends, g, h, n, own.feature.shape[1])
                        yield from ((at, int(node), h[i].ravel()) for i, node in enumerate(n))

                found = best_of(self._summed(work, p), lambda h: boost_splits(h, p), {(m, at): len(columns[m]) for m in asked})
                for m, n in asked.items():
                    rows = tuple(np.array(c) for c in zip(*(found[m, at, int(i)] for i in n)))
                    nodes[m] = set_splits(trees[m], at, n, columns[m], rows, shapes[m].edges, boost_value(p), 1)
                nodes |= {m: np.zeros(0, np.int64) for m in models if m not in asked}
        return trees

    def _forest(self, p: Forest, models: list[int]) -> dict[int, Trees]:
        """Level by level; trees whose nodes fit into PASS_BYTES share a pass."""
        trees = {m: Trees.empty(p.trees, p.depth) for m in models}
        width, shapes = len(self.features), self.shapes
        each = p.columns(width) * BINS * 3 * 8
        waiting = {(m, t): np.zeros(1, np.int64) for m in models for t in range(p.trees)}
        for _ in range(p.depth):
            level, waiting = list(waiting.items()), {}
            while level:
                asked, size = {}, 0
                while level and (not asked or size + len(level[-1][1]) * each <= PASS_BYTES):
                    key, nodes = level.pop()
                    asked[key] = nodes
                    size += len(nodes) * each
                columns = {(m, t): forest_columns(p, width, m, t, n) for (m, t), n in asked.items()}
                sent = {(m, t): trees[m].part(t, t + 1) for m, t in asked}

                def work(block: Block, asked=asked, columns=columns, sent=sent) -> Iterator:
                    for (m, t), n in asked.items():
                        if m == block.model:
                            rows, w, positive = forest_sample(block, t, p, shapes[m].balanced)
                            bins, own = block.bins[rows], sent[m, t]
                            h = forest_histogram(bins, own.nodes_of(0, bins), w, positive, n, columns[m, t], own.feature.shape[1])
                            yield from ((t, int(node), h[i].ravel()) for i, node in enumerate(n))

                found = best_of(self._summed(work, p), lambda h: forest_splits(h, p), {k: p.columns(width) for k in asked})
                for (m, t), n in asked.items():
                    rows = tuple(np.array(c) for c in zip(*(found[m, t, int(i)] for i in n)))
                    below = set_splits(trees[m], t, n, columns[m, t], rows, shapes[m].edges, forest_value, 0)
                    if len(below):
                        waiting[m, t] = below
        return trees

    def _newton(self, p: Newton, models: list[int]) -> dict[int, np.ndarray]:
        weights, shapes = {m: np.zeros(len(self.features) + 1) for m in models}, self.shapes
        going = list(models)
        for _ in range(p.steps):
            now = {m: weights[m] for m in going}

            def work(block: Block, now=now) -> Iterator:
                if block.model in now:
                    yield 0, 0, newton_sums(block, now[block.model], shapes[block.model].balanced)

            left = {}
            for r in self._summed(work, p).collect():  # a row per model
                weights[r["model"]], left[r["model"]] = newton_step(weights[r["model"]], np.frombuffer(r["sums"], float), p)
            going = [m for m in going if left[m] >= p.tolerance]
            if not going:
                break
        return weights


SUMS = "model int, tree int, node int, sums binary"
_margins: dict = {}


def remembered_margins(run_id: str, block: Block, trees: Trees, rounds: int) -> np.ndarray:
    """Margins after ``rounds`` trees, from the last that this worker has computed."""
    if len(_margins) > 64:
        _margins.clear()
    done, margins = _margins.get((run_id, block.name), (0, None))
    if margins is None or done > rounds:
        done, margins = 0, np.zeros(len(block.y))
    for at in range(done, rounds):
        margins = margins + trees.value[at, trees.nodes_of(at, block.bins)]
    _margins[run_id, block.name] = (rounds, margins)
    return margins


def read_block(batch: pa.RecordBatch, i: int, width: int) -> Block:
    get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
    return Block(
        batch.column("model")[i].as_py(), batch.column("block")[i].as_py(), get("ids", np.uint64), get("y", float),
        get("x", float).reshape(-1, width), get("bins", np.uint8).reshape(-1, width),
    )


def joined(blocks: list[Block]) -> Block:
    """The rows of a model's blocks as one."""
    if len(blocks) == 1:
        return blocks[0]
    return Block(blocks[0].model, "", *(np.concatenate([getattr(b, a) for b in blocks]) for a in ("ids", "y", "x", "bins")))


def summed_rows(sums: dict) -> Iterator[pa.RecordBatch]:
    items = list(sums.items())
    for at in range(0, len(items), 256):
        part = items[at : at + 256]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[j] for k, _ in part], pa.int32()) for j in range(3)), pa.array([v.tobytes() for _, v in part], pa.binary())],
            ["model", "tree", "node", "sums"],
        )


def combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sums added by key; rows of a key follow each other, so one sum is in memory."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, ready = None, None, {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, key in enumerate(zip(*columns)):
                array = np.frombuffer(batch.column("sums")[i].as_buffer(), float)
                if key == current:
                    total = total + array
                    continue
                if current is not None:
                    ready[current] = total
                    if len(ready) >= 256:
                        yield from summed_rows(ready)
                        ready = {}
                current, total = key, array
        if current is not None:
            ready[current] = total
        yield from summed_rows(ready)

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, SUMS)


def best_of(sums: DataFrame, splits: Callable, columns: dict[tuple[int, int], int]) -> dict[tuple[int, int, int], tuple]:
    """The best split of every (model, tree, node), found where its sums are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for i, (model, tree) in enumerate(zip(batch.column("model").to_pylist(), batch.column("tree").to_pylist())):
                h = np.frombuffer(batch.column("sums")[i].as_buffer(), float).reshape(1, columns[model, tree], BINS, 3)
                good, column, cut, left, total = splits(h)
                for target, value in zip(out, (bool(good[0]), int(column[0]), int(cut[0]), left[0].tolist(), total[0].tolist())):
                    target.append(value)
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("model", "tree", "node")), *(pa.array(o, k) for o, k in zip(out, kinds))],
                ["model", "tree", "node", "good", "col", "cut", "lower", "total"],
            )

    kinds = "model int, tree int, node int, good boolean, col int, cut int, lower array<double>, total array<double>"
    rows = sums.mapInArrow(run, kinds).collect()  # a row per node of a level
    return {(r["model"], r["tree"], r["node"]): (r["good"], r["col"], r["cut"], r["lower"], r["total"]) for r in rows}


def predict(rows: DataFrame, features: list[str], models: dict[int, Trees | np.ndarray], p: Boosting | Forest | Newton) -> DataFrame:
    """model, customer_id, churn, probability and churn_prediction of rows that name their model."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in features]) if len(batch) else np.zeros((0, len(features)))
            numbers, out = batch.column("model").to_numpy(), np.zeros(len(batch))
            for m, found in models.items():
                at = np.flatnonzero(numbers == m)
                if not len(at):
                    continue
                if isinstance(p, Newton):
                    out[at] = 1 / (1 + np.exp(-(x[at] @ found[:-1] + found[-1])))
                elif isinstance(p, Boosting):
                    out[at] = 1 / (1 + np.exp(-found.sums(x[at])))
                else:
                    out[at] = found.sums(x[at]) / len(found.feature)
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("customer_id"), batch.column("churn"), pa.array(out)], ["model", "customer_id", "churn", "probability"])

    asked = rows.select(F.col("model").cast("int"), F.col("customer_id").cast("string"), F.col("churn").cast("int"), *[F.col(c).cast("double").alias(c) for c in features])
    scored = asked.mapInArrow(score, "model int, customer_id string, churn int, probability double")
    return scored.withColumn("churn_prediction", (F.col("probability") >= 0.5).cast("int"))
