"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

The references are cut into blocks at content-defined anchors: the anchor of a window of
WINDOW words is the smallest hash among its ANCHOR-word grams, and neighbouring windows with
one anchor make a block. The anchors and block hashes of all documents are the index; the
reference of a block is its first place in the smallest document that holds it. A document is
parsed from left to right into factors (start, length, reference, position): a factor begins
at the first block whose reference lies in a smaller document and is extended greedily, over
block edges, as long as the next windows stand at the same distance in the same reference.
Where a factor begins or ends, the block's anchor is shared but the block as a whole is not;
there the windows are checked one by one against the reference blocks with that anchor. All
windows that a smaller document holds are so found: a window's anchor depends on the window's
words only. Factors are WINDOW words long at least and become the duplicate spans.

Windows and blocks are compared by 128 bits (anchor and hash). Blocks of anchors that one
block of one document has are dropped early, by an aggregate. Frequent passages are one row
per block after map-side aggregates; joins back have one row per block on the other side.

Nulls, ties, odd rows: a null text has no words; equal texts with equal doc_id stay; a document
with a null doc_id is neither a reference nor changed. Texts under WINDOW words stay whole. Of
equal passages in one reference the first place counts. An empty table gives no row. A text is
cut as a whole, so memory grows with the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.shingles import gram_hashes, hashes_of, run_hashes, sliding_min
from keepsake.llm.store import discard, fill_text, ship_package, use_memory, written

WINDOW, ANCHOR = 50, 16
#: Words that are hashed together.
CHUNK_WORDS = 400_000
_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("reference", pa.int64()), ("position", pa.int32())])

def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and tab to carriage return, as UTF-8."""
    return text.encode().split() if text else []


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batch, their word counts and their words' hashes, some rows at a time."""
    rows, counts, hashes, held = [], [], [], 0
    for row, text in enumerate(batch.column("text")):
        words = words_of(text.as_py())
        if len(words) >= WINDOW:
            rows.append(row)
            counts.append(len(words))
            hashes.append(hashes_of(words))
            held += len(words)
        if held >= CHUNK_WORDS:
            yield np.array(rows), np.array(counts), np.concatenate(hashes)
            rows, counts, hashes, held = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(counts), np.concatenate(hashes)


def _windows(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per window inside one document: document (of the chunk), start in it, hash, anchor."""
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    inside = np.flatnonzero(owner[: len(hashes) - WINDOW + 1] == owner[WINDOW - 1 :])
    window = gram_hashes(hashes, WINDOW)[inside]
    anchor = sliding_min(gram_hashes(hashes, ANCHOR), WINDOW - ANCHOR + 1)[inside]
    return owner[inside], inside - begin[owner[inside]], window, anchor


def _blocks(docs: DataFrame) -> DataFrame:
    """anchor, block, doc_id, text_key, start, n of every block of every document."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("words")
        for batch in batches:
            doc_ids, keys = batch.column("doc_id").to_numpy(False), batch.column("text_key").to_numpy(False)
            for rows, counts, hashes in _chunks(batch):
                owner, start, window, anchor = _windows(counts, hashes)
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
                end = np.r_[new[1:], len(anchor)]
                block, row = run_hashes(window, new, end), rows[owner[new]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[new].view(np.int64)), pa.array(block.view(np.int64)), pa.array(doc_ids[row]),
                        pa.array(keys[row]), pa.array(start[new].astype(np.int32)), pa.array((end - new).astype(np.int32)),
                    ],
                    ["anchor", "block", "doc_id", "text_key", "start", "n"],
                )

    return docs.mapInArrow(parse, "anchor long, block long, doc_id long, text_key long, start int, n int")


def _block_windows(docs: DataFrame) -> DataFrame:
    """anchor, block, first_doc, nth, place, window: the windows of the asked blocks of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], []]
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, text, asked in zip(doc_ids, texts, batch.column("asked").to_pylist()):
                window = gram_hashes(hashes_of(words_of(text)), WINDOW)
                for one in asked:
                    n = one["n"]
                    for column, value in zip(out, (one["anchor"], one["block"], doc_id)):
                        column.append(np.full(n, value, np.int64))
                    out[3].append(np.arange(n, dtype=np.int32))
                    out[4].append(np.arange(one["start"], one["start"] + n, dtype=np.int32))
                    out[5].append(window[one["start"] : one["start"] + n].view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor", "block", "first_doc", "nth", "place", "window"])

    return docs.select("doc_id", "text", "asked").mapInArrow(run, "anchor long, block long, first_doc long, nth int, place int, window long")


def _keyed(docs: DataFrame) -> DataFrame:
    text = fill_text()
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": text, "text_key": F.xxhash64(text)})


def duplicate_windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, runs: per document the runs (start, n, reference, position) of windows
    that also start in a document with a smaller doc_id, and where there."""
    ship_package(docs.sparkSession)
    keyed = _keyed(docs).filter("doc_id is not null").select("doc_id", "text", "text_key")
    blocks = written(_blocks(keyed), "blocks")
    shared = blocks.groupBy("anchor").agg(
        F.min("block").alias("b0"), F.max("block").alias("b1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")
    ).filter("d0 <> d1").select("anchor", (F.col("b0") != F.col("b1")).alias("several"))
    # aggregates are written before they are joined back, so that the join's long side can be split
    shared = written(shared, "shared-anchors")
    met = written(blocks.join(shared, "anchor"), "shared-blocks")
    discard(blocks, shared)
    first = met.groupBy("anchor", "block", "several").agg(F.min(F.struct("doc_id", "text_key", "start", "n")).alias("first"))
    first = written(first, "reference-blocks")
    asked = first.filter("several").select("first.*", "anchor", "block").groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("anchor", "block", "start", "n")).alias("asked")
    )
    windows = written(_block_windows(keyed.join(asked, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])), "edge-windows")
    held = windows.groupBy("anchor", "window").agg(
        F.min(F.struct("first_doc", "place")).alias("least"), F.max("first_doc").alias("d1")
    ).select("anchor", "window", F.col("least.first_doc").alias("d0"), F.col("least.place").alias("p0"), "d1").filter("d0 < d1").drop("d1")
    held = written(held, "shared-windows")
    edges = windows.join(held, ["anchor", "window"]).filter("first_doc > d0")
    edges = edges.groupBy("anchor", "block").agg(F.collect_list(F.struct("nth", "d0", "p0")).alias("found"))
    known = first.select("anchor", "block", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    known = known.join(edges, ["anchor", "block"], "left")
    whole = F.array(F.struct("start", "n", F.col("first_doc").alias("reference"), F.col("first_start").alias("position")))
    single = F.transform("found", lambda w: F.struct(
        (F.col("start") + w["nth"]).alias("start"), F.lit(1).alias("n"), w["d0"].alias("reference"), w["p0"].alias("position")
    ))
    known = written(known, "judged-blocks")
    discard(first, windows, held)
    runs = met.join(known, ["anchor", "block"]).select(
        "doc_id", "text_key", F.when(F.col("doc_id") > F.col("first_doc"), whole).otherwise(single).alias("runs")
    )
    return runs.filter("runs is not null").groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def factors_of(runs: list[dict]) -> list[tuple[int, int, int, int]]:
    """The factors (start, length in words, reference, position) of a document, left to right:
    each is extended as long as the next windows follow it in the same reference."""
    out: list[list[int]] = []
    for start, n, reference, position in sorted((r["start"], r["n"], r["reference"], r["position"]) for r in runs):
        if out and out[-1][2] == reference and out[-1][0] + out[-1][1] == start and out[-1][3] + out[-1][1] == position:
            out[-1][1] += n
        else:
            out.append([start, n, reference, position])
    return [(start, n + WINDOW - 1, reference, position) for start, n, reference, position in out]


def covered_spans(n_words: int, factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The spans of words (start, length) that factors cover, joined."""
    edge = np.zeros(n_words + 1, np.int64)
    for start, length, *_ in factors:
        edge[start] += 1
        edge[start + length] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    return [(int(a), int(b - a)) for a, b in turns.reshape(-1, 2)]


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """The documents with n_words, n_removed, kept_sha256, factors (word start and length, the
    reference document and the word there), spans (what factors cover, joined) and, with
    ``texts``, kept_text: the text itself where nothing is removed, else the kept words joined
    by one space. Columns of these names in the input are replaced."""
    own = ("doc_id", "text", "n_words", "n_removed", "kept_sha256", "factors", "spans", "kept_text", "runs", "_doc", "_key")
    extra = [c for c in docs.columns if c not in own] if texts else []
    schema = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("words")
        for batch in batches:
            n_words, removed, digests, parsed, spans, kept_texts = [], [], [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = words_of(text)
                factors = factors_of(runs) if runs else []
                found = covered_spans(len(words), factors) if factors else []
                kept, at = [], 0
                for start, length in found:
                    kept += words[at:start]
                    at = start + length
                joined = b" ".join(kept + words[at:] if found else words)
                n_words.append(len(words))
                removed.append(sum(length for _, length in found))
                digests.append(hashlib.sha256(joined).hexdigest())
                parsed.append([dict(zip(("start", "length", "reference", "position"), f)) for f in factors])
                spans.append([{"start": a, "length": b} for a, b in found])
                kept_texts.append(joined.decode() if found else text)
            columns = [batch.column(f.name) for f in schema if f.name != "text"] + [
                pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                pa.array(parsed, pa.list_(_FACTOR)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
            ]
            names = [f.name for f in schema if f.name != "text"] + ["n_words", "n_removed", "kept_sha256", "factors", "spans"]
            if texts:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    found = duplicate_windows(docs).withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_key")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)
    joined = base.join(found, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64(fill_text()) == F.col("_key")), "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "text")
    kinds += ", n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int,reference:long,position:int>>, spans array<struct<start:int,length:int>>"
    return joined.drop("_doc", "_key").mapInArrow(cut, kinds + (", kept_text string" if texts else ""))
