"""Minority oversampling by interpolation between nearest neighbours.

Neighbours are exact. Equal rows are merged first, so copies (one group may hold a third
of all rows) never meet each other pair by pair: their mutual distance is known to be 0.
The distinct rows are parted by pivots; a row meets its own cell and the cells that can hold
a closer row than its k-th so far. A task compares blocks of bounded size and returns only
the nearest few per row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions.ranking import global_positions
from keepsake.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package


#: Most pivots, and rows of a block.
MOST_PIVOTS, BLOCK_ROWS = 1024, 4096
#: Rows whose distances to all pivots are held at once, and pairs of row and cell sent at once.
MEASURED, ROUTED = 1024, 8192


def _nearest_in_blocks(k: int, chunk: int = 256):
    """For one block of asking rows and one of answering rows: each asker's k nearest answers."""
    columns = {"row_id": "int64", "other_id": "int64", "copies": "int64", "distance": "float64"}

    def nearest(asking: pd.DataFrame, answering: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asking) and len(answering):
            a, b = np.stack(asking["x"].to_numpy()), np.stack(answering["other"].to_numpy())
            own, ids = asking["row_id"].to_numpy(), answering["other_id"].to_numpy()
            copies = answering["other_copies"].to_numpy()
            squares = (b * b).sum(axis=1)
            for start in range(0, len(a), chunk):
                x, x_ids = a[start : start + chunk], own[start : start + chunk]
                d = squares - 2.0 * (x @ b.T)
                d[x_ids[:, None] == ids] = np.inf
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if len(b) > k else np.tile(np.arange(len(b)), (len(x), 1))
                asker = np.repeat(np.arange(len(x)), near.shape[1])
                other = near.ravel()
                keep = np.isfinite(d[asker, other])
                asker, other = asker[keep], other[keep]
                found.append(
                    pd.DataFrame(
                        {
                            "row_id": x_ids[asker],
                            "other_id": ids[other],
                            "copies": copies[other],
                            "distance": ((x[asker] - b[other]) ** 2).sum(axis=1),
                        }
                    )
                )
        return pd.concat(found) if found else pd.DataFrame({c: np.array([], t) for c, t in columns.items()})

    return nearest


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] - 2.0 * x @ pivots.T + (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0.0))


def _in_cells(asking: DataFrame, cells: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Each asking row (row_id, x, cell) against the rows of its cell, in blocks of bounded size."""
    asked = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("askers"))
    split = stored(asked.join(sizes.select("cell", "answers"), "cell"))
    own = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asking.join(split, "cell").select("cell", own("askers").alias("asks"), every("answers").alias("block"), "row_id", "x")
    right = cells.join(split, "cell").select(
        "cell", every("askers").alias("asks"), own("answers").alias("block"), F.col("row_id").alias("other_id"),
        F.col("copies").alias("other_copies"), F.col("x").alias("other"),
    )
    left, right = (side.toDF(*side.columns) for side in (left, right))
    keys = ("cell", "asks", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _nearest_in_blocks(k), "row_id long, other_id long, copies long, distance double"
    )


def pivot_cells(distinct: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The rows with their nearest pivot, the cells with size and radius, and the pivots.

    About the square root of the rows are pivots, MOST_PIVOTS at most, so tasks may hold them.
    """
    n = distinct.count()
    wanted = max(1, min(MOST_PIVOTS, math.isqrt(n)))
    chosen = distinct.orderBy(F.xxhash64("row_id"), "row_id").select("x").limit(wanted).collect()
    pivots = np.array([r["x"] for r in chosen])

    def assign(batches):
        for batch in batches:
            for start in range(0, len(batch), MEASURED):
                part = batch.iloc[start : start + MEASURED]
                d = _pivot_distances(np.stack(part["x"].to_numpy()), pivots)
                nearest = d.argmin(axis=1)
                yield part.assign(cell=nearest, away=d[np.arange(len(d)), nearest])

    placed = stored(distinct.mapInPandas(assign, "row_id long, x array<double>, copies long, cell long, away double"))
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"),
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("answers"),
    )
    return placed, stored(sizes), pivots


def routed(batch: pd.DataFrame, pivots: np.ndarray, radius: np.ndarray) -> Iterator[pd.DataFrame]:
    """The cells that each row of a batch may have to meet, in frames of ROUTED rows at most: a row
    may reach every cell, so all pairs of a batch can be a thousand times its size."""
    for start in range(0, len(batch), MEASURED):
        part = batch.iloc[start : start + MEASURED]
        rows = part["x"].to_numpy()
        near = _pivot_distances(np.stack(rows), pivots) - radius <= part["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
        near[np.arange(len(part)), part["cell"].to_numpy()] = False
        row, cell = np.nonzero(near)
        ids = part["row_id"].to_numpy()
        for at in range(0, len(row), ROUTED):
            own = row[at : at + ROUTED]
            yield pd.DataFrame({"row_id": ids[own], "x": rows[own], "cell": cell[at : at + ROUTED]})


def other_cells(bounded: DataFrame, sizes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The cells beside its own in which a row may have a neighbour within its `bound`: by the
    triangle inequality those whose radius reaches to within the bound of the row."""
    listed = sizes.select("cell", "radius").collect()  # one row per pivot
    radius = np.full(len(pivots), -np.inf)
    for r in listed:
        radius[r["cell"]] = r["radius"]

    def route(batches):
        for batch in batches:
            yield from routed(batch, pivots, radius)

    # The rows are few bytes, what they become is not: they are dealt by number.
    dealt = bounded.repartition(max(1, len(pivots) // 4))
    return dealt.mapInPandas(route, "row_id long, x array<double>, cell long")


def nearest_neighbours(distinct: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """Up to k nearest other distinct rows per row, closest first: (row_id, other_id, copies, distance, place).

    Rows belong to the cell of their nearest pivot. A row first meets its own cell; the
    distance of its k-th neighbour there bounds the search, and only cells that reach within
    that bound are met too. Large cells are met in blocks. The result is exact.
    """
    placed, sizes, pivots = pivot_cells(distinct, block_rows or BLOCK_ROWS)
    first = stored(_in_cells(placed.select("row_id", "x", "cell"), placed, sizes, k))
    closest = W.partitionBy("row_id").orderBy("distance", "other_id")
    best = first.withColumn("place", F.row_number().over(closest)).filter(F.col("place") == k)
    bounds = best.select("row_id", F.sqrt("distance").alias("bound"))
    bounded = placed.join(bounds, "row_id", "left").select(
        "row_id", "x", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound")
    )
    more = _in_cells(stored(other_cells(bounded, sizes, pivots)), placed, sizes, k)
    return first.unionByName(more).withColumn("place", F.row_number().over(closest)).filter(F.col("place") <= k)


def _draw(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 1) per row."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def smote(
    frame: DataFrame,
    features: list[str],
    label: str = "churn",
    k: int = 5,
    seed: int = 42,
    block_rows: int | None = None,
) -> DataFrame:
    """Raise the smaller class to the size of the larger one.

    Returns the given rows and the new ones (`synthetic` true), each between a minority row
    and one of its k nearest minority neighbours. Copies count as neighbours at distance 0:
    with m copies of a row, m-1 of its k neighbours are equal to it.
    """
    labelled = frame.filter(F.col(label).isNotNull())
    counts = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}  # two rows
    given = frame.select("customer_id", *features, label, F.lit(False).alias("synthetic"))
    if len(counts) < 2 or len(set(counts.values())) == 1:
        return given
    minority = min(counts, key=counts.get)
    size, missing = counts[minority], max(counts.values()) - counts[minority]
    if size <= k:
        raise ValueError(f"{size} minority rows are too few for {k} neighbours")

    # Rows are numbered in (vector, id) order, so copies stand together yet spread over partitions.
    rows = frame.filter(F.col(label) == minority).select(
        "customer_id", F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    )
    numbered = global_positions(rows, ["x", "customer_id"], "start")
    distinct = stored(
        numbered.groupBy("x").agg(F.min("start").alias("row_id"), F.count(F.lit(1)).alias("copies")).select("row_id", "x", "copies")
    )
    near = stored(nearest_neighbours(distinct, k, block_rows))

    # Every row starts an even share of the new rows; the remainder goes to the first ones.
    share, rest = divmod(missing, size)
    turns = F.when(F.col("start") <= rest, share + 1).otherwise(share)
    # Copies are numbered on from their row_id; a large group is dealt out in runs before it is unrolled.
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BLOCK_ROWS}")))
    runs = distinct.withColumn("run", run).repartition("row_id", "run")
    begin = F.col("row_id") + F.col("run") * BLOCK_ROWS
    end = F.least(begin + BLOCK_ROWS - 1, F.col("row_id") + F.col("copies") - 1)
    starts = runs.withColumn("start", F.explode(F.sequence(begin, end))).select(
        "row_id", "x", "copies", "start", turns.alias("turns")
    ).filter("turns > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turns"))))

    # Neighbour places 0..k-1: own copies first, then the other rows with their copies.
    before = W.partitionBy("row_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    spans = near.select(
        "row_id", "other_id", F.col("copies").alias("other_copies"),
        F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("skip"),
    )
    drawn = starts.select(
        "row_id", "x", "start", "turn",
        (F.floor(_draw(seed, F.col("start"), F.col("turn")) * k) - (F.col("copies") - 1)).alias("at"),
        _draw(seed + 1, F.col("start"), F.col("turn")).alias("u"),
    )
    chosen = drawn.filter(F.col("at") >= 0).join(spans, "row_id").filter(
        (F.col("at") >= F.col("skip")) & (F.col("at") < F.col("skip") + F.col("other_copies"))
    )
    others = distinct.select(F.col("row_id").alias("other_id"), F.col("x").alias("other"))
    between = chosen.join(others, "other_id").select(
        "start", "turn", F.zip_with("x", "other", lambda a, b: a + (b - a) * F.col("u")).alias("x")
    )
    equal = drawn.filter(F.col("at") < 0).select("start", "turn", "x")
    new = between.unionByName(equal).select(
        F.concat_ws("-", F.lit("synthetic"), "start", "turn").alias("customer_id"),
        *[F.col("x")[i].alias(c) for i, c in enumerate(features)],
        F.lit(minority).alias(label),
        F.lit(True).alias("synthetic"),
    )
    return given.unionByName(new)
