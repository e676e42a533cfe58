"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in the order of a hash of their id, form a stream that repeats until
every source has been read once. The stream is cut into blocks of ``block_chars``
characters. With the integer weight ``a`` of a source and the cycle ``A`` (the sum of all
weights), its block k is released at slot ``floor(k A / a)`` and due before slot
``ceil((k + 1) A / a)``. The earliest deadline first among released blocks fills every slot
and meets every deadline, so that a source's share never deviates from its weight by one
block or more. The schedule repeats after A slots and is made by a fold over its slots with
one counter per source.

Default weights have CYCLE slots if that leaves every source within half a block of its
unrounded share over the whole run. Otherwise they are so fine that rounding does not count;
then the slots of the run are made, which are fewer than A, and sources whose share of the
run is below one block take no slot of their own: they are served the characters of their
share, or once if that is more, within a slot of another source.

A document's place is that of the block in which it begins. Prefix sums are taken in two
levels (hash buckets of a source, then rows of a bucket), so no source meets in one task.

Nulls and repeats: a null source is a source of its own; null or empty texts count as one
character; repeated rows each take their own place. An empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.store import ship_package, written

BLOCK_CHARS = 65_536
#: Slots of a cycle that default weights are rounded to where that is fine enough, and slots folded at once.
CYCLE, FOLD = 1000, 1000


def _bucket_digits(rows: int) -> int:
    """Hex digits of the bucket number: about the square root of the rows as buckets."""
    return max(1, math.ceil(math.log(max(rows, 1), 16) / 2))


def _sizes(docs: DataFrame) -> DataFrame:
    """The documents with their columns numbered, so that no name meets one of a helper column,
    and with their characters and their order in the stream."""
    at = {name: F.col(f"c{i}") for i, name in enumerate(docs.columns)}
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumns({
        "_source": F.coalesce(at["source"], F.lit("\u0000")),
        "_chars": F.greatest(F.coalesce(F.length(at["text"]), F.lit(0)), F.lit(1)).cast("long"),
        "_key": F.md5(F.coalesce(at["doc_id"].cast("string"), F.lit(""))),
        "_id": at["doc_id"],
        "_digest": F.md5(F.coalesce(at["text"], F.lit(""))),
    })


def flattened_weights(totals: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """_source, _total, share, weight, fine, small, run: the size to the power 3/4.

    The power makes large sources count less than their size and small ones more. ``share``
    is the unrounded one, ``run`` the blocks until every source has been read once at these
    shares, ``fine`` says that CYCLE slots do not hold them, ``small`` marks the sources
    without slots. Weights of sources with slots add up to the cycle.
    """
    power = F.sqrt(F.col("_total")) * F.sqrt(F.sqrt(F.col("_total")))
    together = Window.partitionBy(F.lit(0))  # a row per source
    share, coarse = F.col("share"), F.col("coarse")
    off = F.abs(coarse / F.sum(coarse).over(together) - share) * F.col("run")
    rated = (
        totals.withColumn("share", power / F.sum(power).over(together))
        .withColumn("coarse", F.greatest(F.round(share * CYCLE), F.lit(1)).cast("long"))
        .withColumn("run", F.max(F.col("_total") / share).over(together) / block_chars)
        .withColumn("fine", F.max((off > 0.5) | (share * CYCLE < 0.5)).over(together))
        .withColumn("small", F.col("fine") & (share * F.col("run") < 1))
    )
    own = F.sum(F.when(~F.col("small"), share)).over(together)
    finest = F.ceil(F.col("run")) * F.count("*").over(together) * 8
    weight = F.when(F.col("fine"), F.greatest(F.round(share / own * finest), F.lit(1))).otherwise(coarse)
    return rated.withColumn("weight", weight.cast("long")).drop("coarse")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _slots(weights: Column, cycle: Column, slots: Column) -> Column:
    """The source index of each of the first ``slots`` slots, from the array of weights and
    their sum. All three are stored columns: an expression would be computed per slot and source."""
    zero = F.lit(0).cast("long")

    def step(state: Column, slot: Column) -> Column:
        served = state["served"]
        due = F.transform(served, lambda n, i: F.when(
            (n < F.get(weights, i)) & (_div(n * cycle, F.get(weights, i)) <= slot),
            F.struct(_div((n + 1) * cycle + F.get(weights, i) - 1, F.get(weights, i)).alias("deadline"), i.alias("index")),
        ))
        pick = F.array_min(due)["index"]
        return F.struct(
            F.transform(served, lambda n, i: n + F.when(i == pick, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("served"),
            F.concat(state["slots"], F.array(pick)).alias("slots"),
        )

    def part(state: Column, first: Column) -> Column:
        start = F.struct(state["served"].alias("served"), F.array().cast("array<int>").alias("slots"))
        made = F.aggregate(F.sequence(first, F.least(first + FOLD, slots) - 1), start, step)
        return F.transform(F.array(made), lambda m: F.struct(
            m["served"].alias("served"), F.concat(state["parts"], F.array(m["slots"])).alias("parts")
        ))[0]

    start = F.struct(F.transform(weights, lambda w: zero).alias("served"), F.array().cast("array<array<int>>").alias("parts"))
    return F.aggregate(F.sequence(zero, slots - 1, F.lit(FOLD).cast("long")), start, part, lambda s: F.flatten(s["parts"]))


def schedule(totals: DataFrame, weights: DataFrame | None, block_chars: int) -> DataFrame:
    """_source, _total, weight, cycle, slots (of its blocks within a cycle) and ``limit``, the
    characters to serve: those up to the slot in which the last source has been read once.
    """
    if weights is None:
        given = flattened_weights(totals, block_chars)
    else:
        given = totals.join(weights, "_source", "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
        given = given.withColumns({"share": F.lit(0.0), "run": F.lit(0.0), "fine": F.lit(False), "small": F.lit(False)})
    given = written(given, "mix-weights")
    once = F.ceil(F.col("_total") / block_chars)
    listed = given.filter("not small").withColumn("once", once).agg(
        F.array_sort(F.collect_list(F.struct("_source", "_total", "weight"))).alias("s"), F.sum("weight").alias("cycle"),
        F.max("fine").alias("fine"), F.collect_list(F.struct("once", "weight")).alias("ends"), F.sum("share").alias("own"),
    ).filter(F.size("s") > 0)
    last = F.array_max(F.transform("ends", lambda e: _div(e["once"] * F.col("cycle") + e["weight"] - 1, e["weight"])))
    listed = listed.withColumn("n", F.when(F.col("fine"), F.least(last, F.col("cycle"))).otherwise(F.col("cycle"))).drop("ends")
    listed = written(listed.withColumn("w", F.transform("s", lambda x: x["weight"])), "mix-listed")
    timed = written(listed.withColumn("order", _slots(F.col("w"), F.col("cycle"), F.col("n"))), "mix-fold")
    taken = timed.select(F.posexplode("order").alias("slot", "i")).groupBy("i").agg(
        F.array_sort(F.collect_list(F.col("slot").cast("long"))).alias("slots")
    )
    each = timed.select("cycle", "own", F.posexplode("s").alias("i", "one")).select(
        "i", "cycle", "own", F.col("one._source").alias("_source"), F.col("one._total").alias("_total"), F.col("one.weight").alias("weight")
    ).join(taken, "i")
    ends = each.withColumn("end", _slot_of(once - 1) + 1).withColumn("horizon", F.max("end").over(Window.partitionBy("cycle")))
    rest = F.size(F.filter("slots", lambda t: t < F.col("horizon") % F.col("cycle")))
    blocks = _div(F.col("horizon"), F.col("cycle")) * F.col("weight") + rest
    slotted = written(ends.withColumn("limit", (blocks * block_chars).cast("long")), "mix-slots")
    columns = ("_source", "_total", "weight", "cycle", "slots", "limit")
    # sources without slots; if no source has any, they follow each other
    run = slotted.agg(F.max("horizon").alias("horizon"), F.max("own").alias("own"))
    small = given.filter("small").withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_source")) - 1)
    small = small.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0)))).crossJoin(run)
    target = F.coalesce(F.col("share") / F.col("own") * F.col("horizon"), F.col("share") * F.col("run")) * block_chars
    slot = F.coalesce(F.floor((F.col("place") + 0.5) * F.col("horizon") / F.col("n")), F.col("place")).cast("long")
    unslotted = small.select(
        "_source", "_total", F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("cycle"), F.array(slot).alias("slots"),
        F.greatest(F.col("_total"), F.least(F.ceil(target), F.lit(block_chars))).cast("long").alias("limit"),
    )
    return slotted.select(*columns).unionByName(unslotted.select(*columns))


def _slot_of(block: Column) -> Column:
    weight = F.col("weight")
    return F.floor(block / weight) * F.col("cycle") + F.get(F.col("slots"), (block % weight).cast("int"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with ``mix_epoch``, ``mix_block`` (of the source) and ``mix_slot``.

    ``weights`` has _source and an integer weight; sources that it doesn't name weigh 1. By
    default the weights are ``flattened_weights``. Reading rows by (mix_slot, source,
    mix_epoch, place) gives the mixed stream. A document comes once per epoch that its source
    reaches; every document comes at least once.

    The schedule has one row per source and one number per slot of a cycle or of the run;
    buckets have one row per source, bucket and epoch, with the slots of that place. Columns ``mix_*`` of the input are replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("mix_epoch", "mix_block", "mix_slot", "mix_start")
    sized = _sizes(docs)
    rows = docs.count()
    bucket = F.substring("_key", 1, _bucket_digits(rows))
    per_bucket = sized.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_chars").alias("_in_bucket"))
    per_bucket = written(per_bucket, "mix-buckets")
    totals = per_bucket.groupBy("_source").agg(F.sum("_in_bucket").alias("_total"))
    plan = written(schedule(totals, weights, block_chars), "mix-schedule")
    before = F.sum("_in_bucket").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_in_bucket")
    begins = per_bucket.withColumn("_before", before).join(plan, "_source").select(
        "*", F.explode(F.expr("sequence(0L, (limit - 1 - _before) div _total)")).alias("mix_epoch")
    )
    offset = "_before + mix_epoch * _total"
    begins = begins.withColumns({
        "_first": F.expr(f"({offset}) div {block_chars}L"),
        "_last": F.expr(f"least({offset} + _in_bucket - 1, limit - 1) div {block_chars}L"),
    }).select(
        "_source", "_bucket", F.col("limit").alias("_limit"), "mix_epoch", "_first", F.expr(offset).alias("_offset"),
        F.expr("transform(sequence(_first, _last), b -> (b div weight) * cycle + get(slots, cast(b % weight as int)))").alias("_slots"),
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "_id", "_digest").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        sized.withColumn("_bucket", bucket)
        .withColumn("_inside", F.sum("_chars").over(inside) - F.col("_chars"))
        .join(begins, ["_source", "_bucket"])
        .withColumn("mix_start", F.col("_offset") + F.col("_inside"))
        .filter("mix_start < _limit")
    )
    return (
        placed.withColumn("mix_block", F.expr(f"mix_start div {block_chars}L"))
        .withColumn("mix_slot", F.expr("get(_slots, cast(mix_block - _first as int))"))
        .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "mix_epoch", "mix_block", "mix_slot", "mix_start")
    )
