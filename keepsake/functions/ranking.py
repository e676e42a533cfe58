"""Global ranking, tiles and exact quantiles without a single-task sort.

An unpartitioned window moves every row into one task. The functions here work
on ranges instead: Spark's range partitioner spreads rows by their full sort key
(ties included, so a value held by a third of all rows is still spread), and only
one number per partition travels to become the partition's offset. Tiles and
quantiles go further: they need no more than the rows standing at the cut
positions, which are found on a value histogram (one row per distinct value, built
with map-side combine). The tile is then a comparison inside the row's own stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.storage import cut_lineage, stored

Cut = tuple[float | None, str | None]
Places = Callable[[int], list[int]]

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id(): row index in its partition


def _with_offsets(placed: DataFrame, totals: Sequence[str]) -> DataFrame:
    """Add `<total>_offset`: the sum over all earlier partitions (one row per partition, so broadcast)."""
    per_part = placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in totals])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in totals]
    )
    return placed.join(F.broadcast(offsets), "_part")


def _placed(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _run_totals(placed: DataFrame, order: Sequence[str | Column], totals: Sequence[str]) -> DataFrame:
    through = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    keep = [c for c in placed.columns if c != "_part"]
    out = _with_offsets(placed, totals).select(
        *keep, *[(F.sum(c).over(through) + F.col(f"{c}_offset")).alias(f"{c}_through") for c in totals]
    )
    return out.select("*", *[(F.col(f"{c}_through") - F.col(c)).alias(f"{c}_before") for c in totals])


def running_totals(df: DataFrame, order: Sequence[str | Column], totals: Sequence[str]) -> DataFrame:
    """Add `<total>_before` and `<total>_through`: global running sums in `order`.

    Meant for frames that are already aggregated to one row per sort key.
    """
    return _run_totals(_placed(df, order), order, totals)


def _sorted_rows(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range partitions, sorted, with partition and row number inside it; no window."""
    return cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(_ROW_BITS))
    )


def global_positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add the 1-based row number over the whole frame; one range shuffle."""
    placed = _sorted_rows(df, order).withColumn("_one", F.lit(1).cast("long"))
    out = _with_offsets(placed, ["_one"])
    return out.withColumn(name, F.col("_row") + 1 + F.col("_one_offset")).drop(
        "_part", "_row", "_one", "_one_offset"
    )


#: Most values that may count as frequent in `add_rank`.
FREQUENT = 64


def _by_type(df: DataFrame, values: dict[str, Column]) -> list[dict[str, Column]]:
    """The columns parted by type: each is ranked in its own, as a common one could merge values."""
    typed = df.select(*[c.alias(n) for n, c in values.items()]).schema
    parted: dict[str, dict[str, Column]] = {}
    for name, column in values.items():
        parted.setdefault(typed[name].dataType.simpleString(), {})[name] = column
    return list(parted.values())


def _stack(df: DataFrame, values: dict[str, Column], tie: str | None) -> DataFrame:
    """ranking, value (and tie) of columns of one type."""
    pairs = F.array(*[F.struct(F.lit(n).alias("ranking"), c.alias("value")) for n, c in values.items()])
    extra = [] if tie is None else [F.col(tie).alias("tie")]
    return df.select(F.explode(pairs).alias("r"), *extra).select("r.*", *(["tie"] if tie else []))


def _value_counts(stacked: DataFrame) -> DataFrame:
    """One row per ranking and distinct value, in range partitions."""
    counts = stacked.groupBy("ranking", "value").agg(F.count(F.lit(1)).alias("n"))
    return _placed(counts, ["ranking", "value"])


def _histogram(counts: DataFrame) -> DataFrame:
    return _run_totals(counts, ["ranking", "value"], ["n"])


def _before_each(sizes: dict[int, int]) -> dict[int, int]:
    """Rows standing before each partition."""
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    return before


def _standing_at(counts: DataFrame, sizes: dict[int, int], places: set[int]) -> list:
    """The histogram rows that cover the places; only the partitions holding one are read on."""
    before = _before_each(sizes)
    parts = sorted({p for p, first in before.items() for at in places if first < at <= first + sizes[p]})
    if not parts:
        return []
    first = F.create_map(*[F.lit(x).cast("long") for p in parts for x in (p, before[p])])
    through = W.partitionBy("_part").orderBy("ranking", "value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ran = counts.filter(F.col("_part").isin(parts)).select(
        "ranking", "value", "n",
        (F.sum("n").over(through) + F.element_at(first, F.col("_part").cast("long"))).alias("n_through"),
    )
    wanted = F.array(*[F.lit(p).cast("long") for p in sorted(places)])
    covered = F.filter(wanted, lambda p: (p > F.col("n_through") - F.col("n")) & (p <= F.col("n_through")))
    rows = ran.withColumn("places", covered).filter(F.size("places") > 0).collect()
    return sorted(rows, key=lambda r: r["n_through"])


def look_up(
    df: DataFrame,
    values: dict[str, Column],
    cuts: dict[str, Places] | None = None,
    quantiles: dict[str, list[float]] | None = None,
    tie: str | None = None,
) -> tuple[dict[str, list[Cut]], dict[str, list[float]]]:
    """Cut rows and exact quantiles of several columns, from one histogram of all of them.

    Order is by value ascending (null first), then by `tie`, which must identify a row.
    `cuts` maps a column's row count to the wanted 1-based places; a cut without tie means
    that the place is the last row of its value, so the value alone separates. Quantiles
    skip nulls and interpolate linearly. What reaches the driver is as long as the places
    asked for: a handful of rows, whatever the data size.
    """
    found_cuts: dict[str, list[Cut]] = {}
    found_quantiles: dict[str, list[float]] = {}
    kinds = _by_type(df, values)
    if len(kinds) > 1:  # each type is counted by itself: compute the values once for all of them
        df = stored(df.select(*[v.alias(f"v_{n}") for n, v in values.items()], *([] if tie is None else [tie])), "ranked")
        kinds = [{n: F.col(f"v_{n}") for n in own} for own in kinds]
    for own in kinds:
        some_cuts, some_quantiles = _look_up(
            _stack(df, own, tie), {n: c for n, c in (cuts or {}).items() if n in own},
            {n: q for n, q in (quantiles or {}).items() if n in own},
        )
        found_cuts |= some_cuts
        found_quantiles |= some_quantiles
    return found_cuts, found_quantiles


def cut_points_by(df: DataFrame, group: Column, value: Column, tie: str, places: dict[str, Places]) -> dict[str, list[Cut]]:
    """Cut rows of one ordering inside each group (named by its text), all in one look-up."""
    stacked = df.select(group.cast("string").alias("ranking"), value.alias("value"), F.col(tie).alias("tie"))
    return _look_up(stacked.filter(F.col("ranking").isin(list(places))), places, {})[0]


def _look_up(
    stacked: DataFrame, cuts: dict[str, Places], quantiles: dict[str, list[float]]
) -> tuple[dict[str, list[Cut]], dict[str, list[float]]]:
    counts = _value_counts(stacked)
    given = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    spans, sizes, first = {}, {}, 0
    per_part = counts.groupBy("ranking", "_part").agg(F.sum("n").alias("rows"), given.alias("given")).collect()
    for row in sorted(per_part, key=lambda r: (r["ranking"], r["_part"])):  # one row per column and partition
        span = spans.setdefault(row["ranking"], {"first": first, "rows": 0, "given": 0})
        span["rows"] += row["rows"]
        span["given"] += row["given"]
        sizes[row["_part"]] = sizes.get(row["_part"], 0) + row["rows"]
        first += row["rows"]
    cut_places = {
        n: [spans[n]["first"] + p for p in places(spans[n]["rows"]) if 0 < p < spans[n]["rows"]]
        for n, places in cuts.items()
        if n in spans
    }
    quantile_places = {
        n: [
            (span["first"] + span["rows"] - span["given"] + 1, (span["given"] - 1) * q)
            for q in quantiles[n]
        ]
        for n, span in spans.items()
        if n in quantiles and span["given"]
    }
    wanted = {p for places in cut_places.values() for p in places}
    wanted |= {start + f(at) for pairs in quantile_places.values() for start, at in pairs for f in (math.floor, math.ceil)}
    hits = _standing_at(counts, sizes, wanted)
    at_place = {place: hit for hit in hits for place in hit["places"]}

    found = _tied_rows(stacked, at_place, sorted({p for places in cut_places.values() for p in places}))
    found_cuts = {n: [found[p] for p in cut_places.get(n, [])] for n in cuts}

    found_quantiles = {}
    for name, fractions in quantiles.items():
        edges = []
        for start, at in quantile_places.get(name, []):
            low = float(at_place[start + math.floor(at)]["value"])
            high = float(at_place[start + math.ceil(at)]["value"])
            edges.append(low + (high - low) * (at - math.floor(at)))
        found_quantiles[name] = edges or [None] * len(fractions)
    return found_cuts, found_quantiles


def _tied_rows(stacked: DataFrame, at_place: dict, places: list[int]) -> dict[int, Cut]:
    """The row at each place; only values that a place splits are sorted by their tie column."""
    found: dict[int, Cut] = {}
    split: dict[tuple, list[int]] = {}
    for place in places:
        hit = at_place[place]
        if place == hit["n_through"]:
            found[place] = (hit["value"], None)
        else:
            split.setdefault((hit["ranking"], hit["value"]), []).append(place)
    if not split:
        return found
    held, local, before = None, {}, 0
    for (name, value), inside in split.items():
        same = (F.col("ranking") == name) & F.col("value").eqNullSafe(F.lit(value))
        held = same if held is None else held | same
        hit = at_place[inside[0]]
        local.update({before + place - (hit["n_through"] - hit["n"]): place for place in inside})
        before += hit["n"]
    rows = _sorted_rows(stacked.filter(held), ["ranking", "value", "tie"])
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # one row per partition
    before, at_row, standing = _before_each(sizes), {}, None
    for position in local:
        part = next(p for p, first in before.items() if first < position <= first + sizes[p])
        at_row[part, position - before[part] - 1] = local[position]
        here = (F.col("_part") == part) & (F.col("_row") == position - before[part] - 1)
        standing = here if standing is None else standing | here
    for row in rows.filter(standing).collect():
        found[at_row[row["_part"], row["_row"]]] = (row["value"], row["tie"])
    return found


def cut_points(df: DataFrame, values: dict[str, Column], tie: str, places: Places) -> dict[str, list[Cut]]:
    """The same places looked up in several orderings at once."""
    return look_up(df, values, cuts=dict.fromkeys(values, places), tie=tie)[0]


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float]]:
    return look_up(
        df, {n: c for n, (c, _) in wanted.items()}, quantiles={n: q for n, (_, q) in wanted.items()}
    )[1]


def past_cut(value: Column, tie: Column, cut: Cut) -> Column:
    """True when the row sorts after the cut (null values first)."""
    at, at_tie = cut
    after = value.isNotNull() if at is None else F.coalesce(value > F.lit(at), F.lit(False))
    if at_tie is None:
        return after
    return after | (value.eqNullSafe(F.lit(at)) & (tie > F.lit(at_tie)))


def tile_column(value: Column, tie: Column, cuts: list[Cut]) -> Column:
    out = F.lit(1)
    for cut in cuts:
        out = out + past_cut(value, tie, cut).cast("int")
    return out.cast("int")


def ntile_places(k: int) -> Places:
    """Last place of each NTILE(k) tile but the final one; the first n%k tiles get one row more."""

    def places(n: int) -> list[int]:
        small, larger = divmod(n, k)
        return [i * small + min(i, larger) for i in range(1, k)]

    return places


def first_rank_places(k: int) -> Places:
    """Cut places of quantile tiles over ranks 1..n (linear quantiles; not the same as NTILE)."""

    def places(n: int) -> list[int]:
        return [math.floor(1 + (n - 1) * i / k) for i in range(1, k)]

    return places


def add_ntiles(df: DataFrame, k: int, values: dict[str, Column], tie: str) -> DataFrame:
    """NTILE(k) over the whole frame for several orderings at once.

    `values` maps the new column to its ascending sort value (negate it for a
    descending order with nulls first).
    """
    cuts = cut_points(df, values, tie, ntile_places(k))
    return df.select("*", *[tile_column(v, F.col(tie), cuts[n]).alias(n) for n, v in values.items()])


def add_first_rank_quartile(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    cuts = cut_points(df, {name: F.col(value)}, tie, first_rank_places(4))
    return df.withColumn(name, tile_column(F.col(value), F.col(tie), cuts[name]))


def add_rank(df: DataFrame, value: Column, name: str) -> DataFrame:
    """RANK over the whole frame, ascending in `value`, null first.

    Ranks come from the value histogram, which has one row per value. Values that hold at
    least a share of 1 / FREQUENT of the rows are FREQUENT at most: their rows get the rank
    from a broadcast of these few and never meet in one task; the others join by value.
    """
    keyed = df.withColumn("_value", value)
    counts = _value_counts(_stack(df, {name: value}, None))
    ranks = _histogram(counts).select(F.col("value").alias("_ranked"), (F.col("n_before") + 1).alias(name), "n")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    often = F.broadcast(ranks.filter(F.col("n") >= least).select("_ranked", F.col(name).alias("_often")))
    same = F.col("_value").eqNullSafe(F.col("_ranked"))
    marked = keyed.join(often, same, "left").drop("_ranked")
    few = marked.filter(F.col("_often").isNotNull()).withColumn(name, F.col("_often"))
    rare = marked.filter(F.col("_often").isNull()).join(ranks.filter(F.col("n") < least).drop("n"), same, "left")
    kept = [c for c in df.columns if c != name]
    return few.select(*kept, name).unionByName(rare.select(*kept, name))


def add_value_quartile(df: DataFrame, value: str, name: str) -> DataFrame:
    """Right-closed quartiles on values; equal edges merge their tiles."""
    edges = exact_quantiles(df, {name: (F.col(value), [0.25, 0.5, 0.75])})[name]
    return df.withColumn(name, value_tile(F.col(value), edges))


def value_tile(value: Column, edges: Sequence[float]) -> Column:
    out = F.lit(1)
    for edge in sorted({e for e in edges if e is not None}):
        out = out + (value.cast("double") > F.lit(edge)).cast("int")
    return out.cast("int")
