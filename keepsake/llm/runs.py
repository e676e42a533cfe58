"""Periodic runs of words, found as maximal pairs in an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and length >= max(least,
exponent * q) that no neighbouring word extends keeping the period. Two equal stretches of
words whose neighbours differ on the left and on the right are a maximal pair; one of length
l and distance d with d + l >= exponent * d is the run from the first word of the one to the
last of the other, so no pair has to be extended. A run of period q also gives the pairs of
distance 2q, 3q, ...; of pairs over the same words the smallest distance is the period.

1. Such pairs are at least ``depth`` words long, so suffixes that share that many words with
   no other suffix of their text are left out, and the others form one bucket per shared
   start. Buckets are sorted by doubling compared lengths, all buckets of many texts at once.
2. Lengths of common prefixes of neighbours come from the ranks of the doublings.
3. A bucket is walked bottom-up as a tree of LCP intervals. A node holds its suffixes in
   order, and where the word to their left changes: joining two nodes looks up, for every
   suffix of the smaller one, the other's suffixes in reach whose left word differs. Each is
   a maximal pair that is reported, so the work follows the output.

A text is cut nowhere, memory grows with the longest text. Nulls, ties, odd rows: a null or
empty text has no word and no run; repeated rows and rows of one doc_id are treated each for
itself; a null doc_id is kept; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.shingles import gram_hashes, mixed
from keepsake.llm.store import fill_text, ship_package, use_memory

#: Fixed by the definition of a run in the query: words at least, and repetitions at least.
LEAST, EXPONENT = 24, 3
#: Words of texts that are sorted together; a longer text is sorted alone.
GROUP_WORDS = 200_000

FIELDS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def pair_depth(least: int, exponent: int) -> int:
    """The fewest words a maximal pair of a run can have: length l = L - q with L >= least and
    L >= exponent * q, so l >= L - L // exponent, and that grows with L."""
    return least - least // exponent


def buckets(codes: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their text and of their next ``depth`` words, and for each one
    the first index with the same words: all positions whose words occur again in their text,
    and those ``depth`` words behind them, whose order is asked for later."""
    grams = gram_hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), depth)
    grams ^= mixed(owner[: len(grams)].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(len(codes) + depth, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again[depth:] |= again[:-depth].copy()
    places = np.flatnonzero(again)
    bits = int(codes.max()).bit_length() + 1 if len(codes) else 1
    each = max(62 // bits, 1)
    columns = []
    for start in range(0, depth, each):
        column = np.zeros(len(places), np.int64)
        for step in range(start, min(start + each, depth)):
            column = (column << bits) | codes[np.minimum(places + step, len(codes) - 1)]
        columns.append(column)
    columns.insert(0, owner[np.minimum(places, len(codes) - 1)])
    order = np.lexsort(columns[::-1])
    places, first = places[order], np.zeros(len(places), np.int64)
    if len(places):
        differ = np.zeros(len(places) - 1, bool)
        for column in columns:
            differ |= column[order[1:]] != column[order[:-1]]
        first[1:] = np.where(differ, np.arange(1, len(places)), 0)
    return places, np.maximum.accumulate(first)


def in_suffix_order(codes: np.ndarray, slots: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots in the order of their suffixes within each bucket, and each one's common
    prefix with the slot before it (0 at the begin of a bucket)."""
    slots, group = slots.copy(), first.copy()
    rank = np.zeros(len(codes) + depth, np.int64)
    rank[slots] = group
    levels, width = [rank.copy()], depth
    while True:
        counts = np.bincount(group, minlength=len(slots))
        active = np.flatnonzero(counts[group] > 1)
        if not len(active):
            break
        after, own = rank[slots[active] + width], group[active]
        order = np.lexsort((after, own))
        slots[active], after = slots[active][order], after[order]
        new = np.ones(len(active), bool)
        new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        group[active] = np.maximum.accumulate(np.where(new, active, 0))
        rank[slots[active]] = group[active]
        levels.append(rank.copy())
        width *= 2
    at = np.flatnonzero(first[1:] == first[:-1]) + 1
    left, right, shared = slots[at - 1], slots[at], np.zeros(len(at), np.int64)
    for level in reversed(range(len(levels))):
        equal = levels[level][left + shared] == levels[level][right + shared]
        shared[equal] += depth << level
    going = np.arange(len(at))
    for _ in range(depth - 1):
        going = going[codes[left[going] + shared[going]] == codes[right[going] + shared[going]]]
        shared[going] += 1
    common = np.zeros(len(slots), np.int64)
    common[at] = shared
    return slots, common


class Suffixes:
    """A node's suffixes in order, and the heads: those whose left word is not the one of the
    suffix before them. Suffixes from one head to the next are a list of one left word."""

    __slots__ = ("places", "heads")

    def __init__(self, place: int):
        self.places, self.heads = [place], [place]

    def add(self, place: int, left) -> None:
        places, heads = self.places, self.heads
        at = bisect_left(places, place)
        after = places[at] if at < len(places) else None
        if at == 0 or left[places[at - 1]] != left[place]:
            insort(heads, place)
        if after is not None:
            where = bisect_left(heads, after)
            is_head = where < len(heads) and heads[where] == after
            if is_head and left[after] == left[place]:
                del heads[where]
            elif not is_head and left[after] != left[place]:
                heads.insert(where, after)
        places.insert(at, place)


def join(x: Suffixes, y: Suffixes, depth: int, reach: int, left, pairs: list) -> Suffixes:
    """Unite two nodes; pairs across them share exactly ``depth`` words."""
    if len(x.places) < len(y.places):
        x, y = y, x
    places, heads = x.places, x.heads
    for place in y.places:
        own, last = left[place], place + reach
        at = bisect_left(places, place - reach)
        while at < len(places) and places[at] <= last:
            other = places[at]
            if left[other] != own:
                pairs.append((min(place, other), abs(place - other), depth))
                at += 1
            else:
                head = bisect_right(heads, other)
                if head == len(heads):
                    break
                at = bisect_left(places, heads[head])
    for place in y.places:
        x.add(place, left)
    return x


def walk(places: list[int], common: list[int], times: int, left, pairs: list) -> None:
    """All maximal pairs (first place, distance, length) of a bucket with distance * times <=
    length, by a bottom-up walk over its LCP intervals."""
    open_nodes: list[tuple[int, Suffixes]] = []
    for at, place in enumerate(places):
        node, depth = Suffixes(place), common[at + 1] if at + 1 < len(places) else 0
        while open_nodes and open_nodes[-1][0] >= depth:
            length, held = open_nodes.pop()
            node = join(held, node, length, length // times, left, pairs)
        open_nodes.append((depth, node))


def runs_of(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start and then period."""
    depth, numbers = pair_depth(least, exponent), {}
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    separators = np.concatenate([[0], np.cumsum(sizes)])  # they stand around every text and equal nothing
    codes = np.empty(int(separators[-1]) + 1, np.int64)
    inside = np.ones(len(codes), bool)
    inside[separators] = False
    number = numbers.setdefault
    codes[inside] = np.fromiter((number(w, len(numbers)) for t in texts for w in t), np.int64, int(inside.sum()))
    codes[separators] = len(numbers) + np.arange(len(separators))
    owner = np.append(np.repeat(np.arange(len(texts)), sizes), len(texts))
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    slots, first = buckets(codes, owner, depth)
    if not len(slots):
        return [[] for _ in texts]
    gaps = np.full(len(slots), len(codes))
    gaps[1:] = np.where(first[1:] == first[:-1], slots[1:] - slots[:-1], len(codes))
    begins = np.flatnonzero(first == np.arange(len(slots)))
    nearest = np.minimum.reduceat(gaps, begins)
    slots, common = in_suffix_order(codes, slots, first, depth)
    times = exponent - 1
    limits = np.append(begins, len(slots))
    for b in np.flatnonzero(nearest <= np.maximum.reduceat(common, begins) // times).tolist():
        places = slots[limits[b] : limits[b + 1]]
        text, pairs = int(owner[places[0]]), []
        left = dict(zip(places.tolist(), codes[places - 1].tolist()))
        walk(places.tolist(), common[limits[b] : limits[b + 1]].tolist(), times, left, pairs)
        runs, begin = found[text], int(separators[text]) + 1
        for place, distance, length in pairs:
            if distance + length >= least:
                key = (place - begin, distance + length)
                runs[key] = min(runs.get(key, distance), distance)
    return [sorted(((s, n, q) for (s, n), q in f.items()), key=lambda r: (r[0], r[2])) for f in found]


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of all runs, and the first period of every run."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    stay = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stay).tolist()]


def stronger(x: Column, y: Column) -> Column:
    """Order of runs for array_sort: greatest length / period, compared exactly, then smallest
    start, then smallest period."""
    by_exponent = F.signum(y.length * x.period - x.length * y.period)
    by_start, by_period = F.signum(x.start - y.start), F.signum(x.period - y.period)
    return F.when(by_exponent != 0, by_exponent).when(by_start != 0, by_start).otherwise(by_period).cast("int")


def find(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per document: its words, its runs by start and period, and the text in which
    every run is cut to its first period (words joined by one space)."""
    if exponent < 3 or least < exponent:
        raise ValueError("a run needs three repetitions at least")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("runs")

        def result(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = runs_of(texts, least, exponent)
            columns = (
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(_RUN)),
                pa.array([b" ".join(kept(t, r)).decode() for t, r in zip(texts, runs)], pa.string()),
            )
            return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_words", "runs", "kept_text"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_py().encode().split()
                if texts and held + len(words) > GROUP_WORDS:
                    yield result(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if texts:
                yield result(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), fill_text().alias("text")).mapInArrow(run, FIELDS)
