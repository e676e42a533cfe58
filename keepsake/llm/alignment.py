"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer.

Both token sequences are seen as ascending byte offsets at which tokens end. An offset where
both end is a cut. A stretch is divided at the cut nearest to its middle, which is located
by bisecting the one side's ends for ends of the other, going outwards; both halves are
treated alike, and a stretch without a cut inside is a leaf: one group of tokens of either
side. Within a group the overlaps of byte ranges are the links.

Both tokenizers always end a token before a space that stands alone between two visible
characters, so texts are divided there first and the alignment of each distinct piece of many
texts is found once. If a vocabulary has pieces that span such a space, whole texts are
divided instead.

How often two ids are linked is counted over the whole corpus: tasks add up their own pairs,
one shuffle adds the tasks' counts. Documents ask for the counts of their pairs in chunks:
a chunk names each of its pairs once, so a pair that every document holds is one row per
chunk, not one per document or link, and no counts are broadcast. The table of counts grows
with the pairs that occur, which the vocabularies bound.

Nulls, ties, odd rows: a null or empty text, or one whose tokens do not spell a space and the
text on both sides (a normalising vocabulary changed it), has no tokens: zeros and no groups.
Pairs of equal counts are all best. A null doc_id is kept, repeated rows are counted each,
other columns are ignored, an empty table gives no row. Memory grows with the longest text.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.store import fill_text, memory, ship_package, use_memory, written
from keepsake.llm.tokens import Remembered, byte_letters, default_vocabulary, encoder, gather, grouped, pieces_of

#: Links of a chunk of documents, which ask together for the counts of their pairs.
CHUNK_LINKS = 2_000_000
#: Distinct pairs that a task counts before it hands them on.
HELD_PAIRS = 2_000_000
SHIFT = 32


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut_near_middle(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> tuple[int, int] | None:
    """Indices of a common end in a[a0:a1] and b[b0:b1], the one nearest to the middle of the
    shorter range that going outwards meets first; None if there is none."""
    if a1 - a0 > b1 - b0:
        found = cut_near_middle(b, b0, b1, a, a0, a1)
        return found and (found[1], found[0])
    low = (a0 + a1) // 2
    high = low + 1
    while low >= a0 or high < a1:
        if low >= a0:
            at = bisect_left(b, a[low], b0, b1)
            if at < b1 and b[at] == a[low]:
                return low, at
            low -= 1
        if high < a1:
            at = bisect_left(b, a[high], b0, b1)
            if at < b1 and b[at] == a[high]:
                return high, at
            high += 1
    return None


def leaves(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """The groups of two token sequences with the same last end: (a0, a1, b0, b1) in order."""
    waiting, out = [(0, len(a), 0, len(b))], []
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        cut = cut_near_middle(a, a0, a1 - 1, b, b0, b1 - 1)
        if cut is None:
            out.append((a0, a1, b0, b1))
        else:
            i, j = cut[0] + 1, cut[1] + 1
            waiting += [(i, a1, j, b1), (a0, i, b0, j)]
    return out


def overlaps(a: list[int], b: list[int], leaf: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """The token pairs of a group whose byte ranges overlap."""
    i, a1, j, b1 = leaf
    out = []
    while i < a1 and j < b1:
        out.append((i, j))
        if a[i] <= b[j]:
            i += 1
        else:
            j += 1
    return out


class Aligner:
    """Both tokenizers of a worker and what it remembers of pieces."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece

        self.a = encoder(vocabulary, True)
        self.kind = "H" if self.a.dtype.itemsize == 2 else "I"
        back = {letter: byte for byte, letter in byte_letters().items()}
        tool = self.a.tokenizer
        self.a_bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in map(tool.id_to_token, range(self.a.size))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = [self.b.is_byte(i) for i in range(len(names))]
        self.b_bytes = [bytes([int(n[1:-1], 16)]) if h else n.replace("▁", " ").encode() for n, h in zip(names, byte)]
        self.by_pieces = self.a.by_pieces and not any("▁" in n.lstrip("▁") for n in names)
        self.decimals = [str(i) for i in range(max(self.a.size, len(names)))]
        self.known = Remembered(self.aligned)
        memory("alignment", self.known.clear)

    def aligned(self, texts: list[str]) -> list[tuple]:
        """(tokens of A, of B, groups, links, pairs, groups in text) of each text behind a space,
        or None where the tokens do not spell it."""
        out = []
        name, a_bytes, b_bytes = self.decimals.__getitem__, self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for text, a_raw, b_ids in zip(texts, self.a.after_space(texts), self.b.encode(texts, num_threads=1)):
            a_ids = array(self.kind, a_raw).tolist()
            a_tokens, b_tokens = list(map(a_bytes, a_ids)), list(map(b_bytes, b_ids))
            if not b"".join(a_tokens) == b"".join(b_tokens) == b" " + text.encode() or not a_ids:
                out.append((0, 0, 0, -1, b"", ""))
                continue
            a_ends, b_ends = list(accumulate(map(len, a_tokens))), list(accumulate(map(len, b_tokens)))
            groups = leaves(a_ends, b_ends)
            links = [(a_ids[i] << SHIFT) | b_ids[j] for leaf in groups for i, j in overlaps(a_ends, b_ends, leaf)]
            a_names, b_names = list(map(name, a_ids)), list(map(name, b_ids))
            text_of = ";".join([f"{','.join(a_names[a0:a1])}|{','.join(b_names[b0:b1])}" for a0, a1, b0, b1 in groups])
            out.append((len(a_ids), len(b_ids), len(groups), len(links), array("Q", links).tobytes(), text_of))
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray, str]]:
        """(n_a, n_b, n_groups, n_links, distinct pairs, their links, groups in text) of each."""
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if self.by_pieces:
            pieces, numbers, bounds = pieces_of(texts)
        else:
            pieces, numbers, bounds = texts, np.arange(len(texts)), np.arange(len(texts) + 1)
        found = self.known.of(pieces, np.bincount(numbers, minlength=len(pieces)))
        figures = np.array([f[:4] for f in found], np.int64).reshape(-1, 4)
        in_text = np.array([f[5] for f in found], object)
        values = np.frombuffer(b"".join([f[4] for f in found]), np.uint64)
        links, ends = gather(values, np.maximum(figures[:, 3], 0), numbers)
        begin = 0
        for i, text in enumerate(texts):
            own = numbers[bounds[i] : bounds[i + 1]]
            end = int(ends[bounds[i + 1] - 1])
            if not text or (figures[own, 3] < 0).any():
                yield 0, 0, 0, 0, *none, ""
            else:
                pairs, times = np.unique(links[begin:end], return_counts=True)
                yield *figures[own].sum(0).tolist(), pairs, times, ";".join(in_text[own].tolist())
            begin = end


@lru_cache(maxsize=2)
def aligner(vocabulary: str, pieces: str) -> Aligner:
    return Aligner(vocabulary, pieces)


def align(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row per document: token, group and link numbers, ``groups`` as decimal ids
    (``a1,a2|b1;a3|b2,b3``), its distinct id pairs (A's id in the upper half) with the number of
    links of each, and the chunk of documents it belongs to."""
    vocabulary, pieces = vocabulary or default_vocabulary(), pieces or default_pieces()
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("alignment")
        tool, chunk, held = aligner(vocabulary, pieces), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts, at = batch.column("doc_id"), batch.column("text").to_pylist(), 0
            for group in grouped(texts):
                columns: list[list] = [[] for _ in range(8)]
                for *figures, found, times, in_text in tool.texts(group):
                    for column, value in zip(columns, (*figures, in_text, found.view(np.int64), times, chunk)):
                        column.append(value)
                    held += figures[3]
                    if held >= CHUNK_LINKS:
                        chunk, held = chunk + 1, 0
                kinds = [*[pa.int64()] * 4, pa.large_string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                names = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "chunk"]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(group)), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names]
                )
                at += len(group)

    rows = docs.select(F.col("doc_id").cast("long"), fill_text().alias("text"))
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>, chunk long"
    return rows.mapInArrow(run, kinds)


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(values[order], begins) if len(begins) else values[:0]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus), best (n is the highest of B's id)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, flat(batch.column("pairs"))])
            values = np.concatenate([values, flat(batch.column("times"))])
            keys, values = added(keys, values)
            if len(keys) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["pair", "n"])
                keys, values = keys[:0], values[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["pair", "n"])

    counted = aligned.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))), "pair-counts")
    highest = counted.groupBy("b").agg(F.max("n").alias("highest"))
    return counted.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """The documents with n_best (links whose count is the highest of their B id) and count_sum
    (the sum of their links' counts). ``aligned`` is a written result of ``align``."""
    asked = aligned.select("chunk", "pairs")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, held = None, [], 0

        def distinct() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk or 0)), pa.array(keys)], ["chunk", "pair"])

        for batch in batches:
            owners, column = batch.column("chunk").to_numpy(), batch.column("pairs")
            cuts = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x < y:
                    if owners[x] != chunk or held > HELD_PAIRS:
                        yield distinct()
                        chunk, parts, held = int(owners[x]), [], 0
                    parts.append(flat(column.slice(x, y - x)))
                    held += len(parts[-1])
        yield distinct()

    wanted = asked.mapInArrow(ask, "chunk long, pair long").distinct()
    answers = wanted.join(pair_counts(aligned), "pair").select("chunk", "pair", "n", "best")
    keep = [c for c in aligned.columns if c not in ("pairs", "times", "chunk", "groups")]
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}

    def answer(docs: pa.Table, counts: pa.Table) -> pa.Table:
        keys = counts.column("pair").to_numpy()
        order = np.argsort(keys)
        keys, n, best = keys[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
        docs = docs.combine_chunks()
        sums, bests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        column, weights = docs.column("pairs").combine_chunks(), docs.column("times").combine_chunks()
        sizes = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        if len(keys):
            at, times = np.searchsorted(keys, flat(column)), flat(weights)
            owner = np.repeat(np.arange(len(docs)), sizes)
            np.add.at(sums, owner, times * n[at])
            np.add.at(bests, owner, times * best[at])
        out = docs.select(keep)
        return out.append_column("n_best", pa.array(bests)).append_column("count_sum", pa.array(sums))

    shape = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_best long, count_sum long"
    asking = aligned.select(*keep, "pairs", "times", "chunk")
    return asking.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, shape)
