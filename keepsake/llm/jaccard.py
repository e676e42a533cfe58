"""N-gram Jaccard join: documents linked by 0.8 of their 5-word shingles, by signature trees.

1. Each document gives its number of shingles, a hash of the whole set, a bitmap of about
   two bits per shingle, and the prefix of its shingles in a fixed order. Equal sets are one
   class, stood for by its smallest doc_id.
2. Linked sets share a shingle of their prefixes, so classes meet by these shingles. Among
   those that meet by one shingle, trees of bitmaps and size ranges are traversed in pairs;
   pairs that the bounds can't exclude are candidates, kept as stars over their groups.
3. Groups of candidates (connected components) get their texts, once per document; a second
   traversal with the exact sets unites what is linked.

The order of shingles is by hash, frequent ones last. The prefix holds ``n - ceil(0.8 n) + 1``
shingles, which is exact in any order: two linked sets share a shingle of their prefixes. So every
document is joined by its whole prefix, and which shingles count as frequent, read off a bounded
sample of documents, changes the work but no link. ``exact=False`` takes the first 40 only where at
most 40 % of the set are frequent, which may miss a link.

Groups above a size are split into blocks, and every pair of blocks is a task of its own, so
memory is bounded whatever the size of a group.

Nulls, repeats, odd rows: texts without words link with nothing; rows of one doc_id are one
node of the graph, which has the links of all its texts, in whatever order they come; a null
doc_id links with nothing and has a null component; other columns are ignored; an empty table
gives no row; a text is compared as a whole, so memory grows with the longest one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.graph import components
from keepsake.llm.shingles import gram_hashes, hashes_of
from keepsake.llm.signature_tree import PERCENT, Groups, unite, width_of
from keepsake.llm.store import fill_text, ship_package, use_memory, written

SHINGLE = 5
#: Shingles of a prefix where few of the set are frequent, and that share.
PREFIX, RARE_SHARE = 40, 0.6
#: Documents of the sample for frequent shingles; a shingle in this many of them is frequent.
SAMPLE, FREQUENT_IN, MOST_FREQUENT = 4000, 8, 50_000
#: Members of a block; larger groups are split.
BLOCK = 4000

def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole text if it is shorter."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(hashes_of(words), min(SHINGLE, len(words))))


def bitmap(grams: np.ndarray) -> bytes:
    bits = np.zeros(width_of(len(grams)), np.uint8)
    bits[grams & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def prefix(grams: np.ndarray, frequent: np.ndarray, exact: bool = True) -> np.ndarray:
    n = len(grams)
    if not n:
        return grams
    at = np.searchsorted(frequent, grams)
    often = np.zeros(n, bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == grams
    size = n - (PERCENT * n + 99) // 100 + 1
    if not exact and n - often.sum() >= RARE_SHARE * n:
        size = min(size, PREFIX)
    return np.concatenate([grams[~often], grams[often]])[:size]


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in FREQUENT_IN of about SAMPLE documents chosen by a hash; at most
    MOST_FREQUENT of them, whatever the input. They only order the prefixes."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("words")
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], ["gram"])

    often = chosen.select(fill_text().alias("text")).mapInArrow(each, "gram long").groupBy("gram").count()
    top = often.filter(F.col("count") >= FREQUENT_IN).orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT)
    return np.sort(np.array([r.gram for r in top.collect()], np.int64).view(np.uint64))


def signatures(docs: DataFrame, exact: bool = True) -> DataFrame:
    """doc_id, n, s1, s2 (hash of the set), keys (the prefix) and bits (the bitmap)."""
    frequent = frequent_shingles(docs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("words")
        for batch in batches:
            out = [[], [], [], [], []]
            for text in batch.column("text"):
                grams = shingles(text.as_py())
                digest = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
                for column, value in zip(out, (len(grams), digest[0], digest[1], prefix(grams, frequent, exact).view(np.int64), bitmap(grams))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n", "s1", "s2", "keys", "bits"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), fill_text().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n long, s1 long, s2 long, keys array<long>, bits binary")


def in_blocks(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Adds lo, hi: the pairs of blocks of its group in which a row takes part."""
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit("block")), n).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}).drop("_own", "_other", size)


def united(rows: DataFrame, group: str, read: Callable[[dict], list], use: Callable[[list, Groups], None]) -> DataFrame:
    """a, b: stars over what ``use`` unites among the rows of each (group, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("words")
        groups, items, current = Groups(), [], None

        def stars() -> pa.RecordBatch:
            pairs = [(x, groups.find(x)) for x in list(groups.parent)]
            pairs = [(x, root) for x, root in pairs if x != root]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs) if pairs else ([], []))], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                key = (row[group], row["lo"], row["hi"])
                if key != current:
                    if len(items) > 1:
                        use(items, groups)
                    items, current = [], key
                    if len(groups.parent) > 500_000:
                        yield stars()
                        groups.parent.clear()
                items.append(read(row))
        if len(items) > 1:
            use(items, groups)
        yield stars()

    dealt = rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame) -> DataFrame:
    """Stars over the classes that may be linked. ``classes``: doc_id, n, keys, bits."""
    keyed = classes.select("doc_id", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("size")).filter("a <> b")
    met = written(met, "shared-shingles")
    pairs = met.filter("size = 2").select("a", "b").distinct()
    twos = pairs.select(F.xxhash64("a", "b").alias("key"), F.lit(2).cast("long").alias("size"), F.explode(F.array("a", "b")).alias("doc_id"))
    more = keyed.join(met.filter("size > 2").select("key", "size"), "key").select("key", "size", "doc_id")
    rows = twos.unionByName(more).join(classes.select("doc_id", "n", "bits"), "doc_id")

    def read(row: dict) -> tuple[int, int, int]:
        return row["doc_id"], row["n"], int.from_bytes(row["bits"], "little")

    def use(items: list, groups: Groups) -> None:
        unite(items, groups, lambda a, b: True)

    return united(in_blocks(rows, "key", "size"), "key", read, use)


def verified(groups_of: DataFrame, docs: DataFrame) -> DataFrame:
    """Stars over the documents that are linked. ``groups_of``: node, component."""
    sizes = groups_of.groupBy("component").agg(F.count("*").alias("size"))
    sized = groups_of.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "size")
    texts = docs.select(F.col("doc_id").cast("long"), fill_text().alias("text")).join(sized, "doc_id")

    def read(row: dict) -> tuple[int, np.ndarray]:
        return row["doc_id"], shingles(row["text"])

    def use(items: list, groups: Groups) -> None:
        sets = defaultdict(list)  # an id may have several texts
        for i, s in items:
            sets[i].append(s)

        def alike(x: np.ndarray, y: np.ndarray) -> bool:
            shared = len(np.intersect1d(x, y, assume_unique=True))
            return (100 + PERCENT) * shared >= PERCENT * (len(x) + len(y))

        def linked(a: int, b: int) -> bool:
            return any(alike(x, y) for x in sets[a] for y in sets[b])

        unite([(i, len(s), int.from_bytes(bitmap(s), "little")) for i, s in items], groups, linked)

    return united(in_blocks(texts, "component", "size"), "component", read, use)


def join(docs: DataFrame, exact: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. With ``exact`` all sets send their whole
    prefix, which leaves no link to chance."""
    ship_package(docs.sparkSession)
    signed = written(signatures(docs, exact), "signatures")
    sets = signed.filter("doc_id is not null and n > 0")
    grouped = sets.groupBy("s1", "s2", "n")
    classes = written(
        grouped.agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "set-classes"
    )
    maybe = components(candidates(classes), "candidate-groups")
    # an id with several texts links the classes of all of them
    kind = F.struct("n", "s1", "s2")
    several = sets.groupBy("doc_id").agg(F.min(kind).alias("x"), F.max(kind).alias("y")).filter("x <> y").select("doc_id")
    own = classes.select("s1", "s2", "n", F.col("doc_id").alias("b"))
    ties = sets.join(several, "doc_id", "left_semi").join(own, ["s1", "s2", "n"]).select(F.col("doc_id").alias("a"), "b")
    linked = components(verified(maybe, docs).unionByName(ties), "linked-groups")
    ids = classes.select("s1", "s2", "n", F.col("doc_id").alias("node")).join(linked, "node", "left").select(
        "s1", "s2", "n", F.coalesce("component", "node").alias("component")
    )
    return signed.join(ids, ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
