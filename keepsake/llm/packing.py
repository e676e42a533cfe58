"""Packing of token ids into training sequences by several context sizes.

Each task packs the documents of its own part of the input, so nothing is shuffled:

1. A document's full windows of the longest tier become sequences at once; what is left is
   routed to the shortest tier that holds it.
2. Tiers are packed from the longest down: the largest remaining piece opens a window of
   its tier.
3. The gap of a window is filled with the largest pieces that fit, from the same or shorter
   tiers; the last bit of a gap is filled by cutting a piece. Windows are so exactly full.
4. What remains at the end of a part, less than one window, is cut at powers of two, which
   need no padding.
5. Sequences of one tier gather into step groups of ``STEP_TOKENS`` tokens; the groups left
   open at the end are dealt anew, largest sequence first to the lightest group.

Nulls and repeats: a null text is empty and still holds the end id; repeated rows are packed
each; a null doc_id is kept. Other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.store import fill_text, ship_package, use_memory
from keepsake.llm.tokens import default_vocabulary, encoder

TIERS = (2048, 1024, 512, 256, 128)
#: Tokens of a step group, and tokens that are packed together.
STEP_TOKENS = 1 << 16
GROUP_TOKENS = 4_000_000

FIELDS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, window int, step_group long"
)
_ARROW = pa.schema(
    [(n, pa.int32() if n == "window" else pa.int64()) for n in (f.split()[0] for f in FIELDS.split(", "))]
)


class Packer:
    """Packing of one part. Pieces are (length, order, doc_id, start, ids, doc_tokens)."""

    def __init__(self, part: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.next_sequence = self.next_step = part << 36
        self.order = 0
        self.pool: list[tuple] = []  # sorted; the order number keeps comparisons from the ids
        self.steps: dict[int, list] = {}  # by window: sequences of the open group
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, total, start = self.tiers[0], len(ids), 0
        while total - start >= top:
            self._emit(top, [self._piece(doc_id, start, ids[start : start + top], total)])
            start += top
        if start < total:
            bisect.insort(self.pool, self._piece(doc_id, start, ids[start:], total))

    def _piece(self, doc_id, start, ids, total):
        self.order += 1
        return (len(ids), self.order, doc_id, start, ids, total)

    def pack(self) -> None:
        """Fill windows while the pool can fill them; the rest waits for more documents."""
        while self.pool:
            window = next(t for t in reversed(self.tiers) if t >= self.pool[-1][0])
            chosen = [self.pool.pop()]
            gap = window - chosen[0][0]
            while gap and self.pool:
                at = bisect.bisect_left(self.pool, (gap + 1,))
                if at:
                    piece = self.pool.pop(at - 1)
                else:  # all are longer than the gap: cut the shortest
                    _, _, doc_id, start, ids, total = self.pool.pop(0)
                    piece = self._piece(doc_id, start, ids[:gap], total)
                    bisect.insort(self.pool, self._piece(doc_id, start + gap, ids[gap:], total))
                chosen.append(piece)
                gap -= piece[0]
            if gap:
                self.pool = sorted(chosen)
                return
            self._emit(window, chosen)

    def finish(self) -> None:
        self.pack()
        left = sum(p[0] for p in self.pool)
        while left:
            window = 1 << (left.bit_length() - 1)
            chosen, gap = [], window
            while gap:
                length, _, doc_id, start, ids, total = self.pool.pop()
                if length > gap:
                    bisect.insort(self.pool, self._piece(doc_id, start + gap, ids[gap:], total))
                    ids = ids[:gap]
                chosen.append(self._piece(doc_id, start, ids, total))
                gap -= len(ids)
            self._emit(window, chosen)
            left -= window
        waiting = sorted((s for group in self.steps.values() for s in group), key=lambda s: -s[0])
        self.steps.clear()
        n = -(-sum(s[0] for s in waiting) // self.step_tokens)
        groups = [[0, i, []] for i in range(n)]
        for sequence in waiting:
            lightest = min(groups)
            lightest[0] += sequence[0]
            lightest[2].append(sequence)
        for group in groups:
            self._close(group[2])

    def _emit(self, window: int, pieces: list[tuple]) -> None:
        rows, offset = [], 0
        for length, _, doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, length, zlib.crc32(ids.astype("<u4")), total, self.next_sequence, offset, window))
            offset += length
        self.next_sequence += 1
        group = self.steps.setdefault(window, [])
        group.append((window, rows))
        if len(group) * window >= self.step_tokens:
            self._close(self.steps.pop(window))

    def _close(self, group: list) -> None:
        self.rows += [(*row, self.next_step) for _, rows in group for row in rows]
        self.next_step += 1

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows) if rows else [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def pack(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 1,
    tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``tiers`` are powers of two, longest first. ``window`` is the sequence's full length,
    ``step_group`` the group of sequences that one training step takes.
    """
    vocabulary = vocabulary or default_vocabulary()
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("tokens")
        tool, packer, held = encoder(vocabulary), Packer(TaskContext.get().partitionId(), tiers, step_tokens), 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                for doc_id, ids in zip(doc_ids[at : at + 500], tool.encode(texts[at : at + 500], end_id)):
                    packer.add(doc_id, ids)
                    held += len(ids)
                if held >= GROUP_TOKENS:
                    packer.pack()
                    held = 0
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("long"), fill_text().alias("text")).mapInArrow(run, FIELDS)
