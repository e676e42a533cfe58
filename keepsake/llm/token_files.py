"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Every id is replaced by its rank (0 = most frequent over all documents, ties by id). Ranks
are stored in one to four bytes; a separate control byte holds the lengths of four ranks,
two bits each, so that a reader finds all lengths, places and masks of a block by indexing
tables of 256 rows. A file ("shard") holds consecutive documents:

    magic ``FVB1`` | documents u32 | ids u64
    doc_id i64 per document | null mark u8 per document | ids u64 per document
    blocks: ids u32, data bytes u32, control bytes, data bytes

Shards follow each other in ascending (doc_id, text hash); the manifest table lists them
with their order. Only shards in the manifest count, so a file left by a lost task does not.

Nulls and repeats: a null text is empty; a null doc_id comes first; equal doc_ids stay as
separate documents in the order of their texts' hashes. Other columns are ignored. An empty
table gives no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.store import fill_text, ship_package, use_memory, written
from keepsake.llm.tokens import default_vocabulary, encoder

MAGIC = b"FVB1"
#: Coded bytes after which a shard is closed, and ids in a block.
SHARD_BYTES = 8_000_000
BLOCK_IDS = 1 << 18

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
#: By control byte: the four masks, the four places in the group's data, and the data's length.
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")[_CODES]
PLACES = np.cumsum(_CODES + 1, axis=1) - (_CODES + 1)
LENGTHS = (_CODES + 1).sum(axis=1)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a block of ranks."""
    ranks = ranks.astype("<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    codes = np.pad(codes, (0, -len(codes) % 4)).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_block(n: int, control: bytes, data: bytes) -> np.ndarray:
    """Ranks of a block; the lanes after the last rank have length one and are cut off."""
    groups = np.frombuffer(control, np.uint8)
    begin = np.cumsum(LENGTHS[groups]) - LENGTHS[groups]
    places = (begin[:, None] + PLACES[groups]).ravel()[:n]
    padded = data + bytes(4)
    words = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    return words[places] & MASKS[groups].ravel()[:n]


def encode_shard(doc_ids: list[int | None], ranks: list[np.ndarray]) -> bytes:
    counts = np.array([len(r) for r in ranks], "<u8")
    joined = np.concatenate(ranks) if ranks else np.zeros(0, "<u4")
    out = [
        MAGIC, np.uint32(len(doc_ids)).tobytes(), np.uint64(len(joined)).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), counts.tobytes(),
    ]
    for at in range(0, len(joined), BLOCK_IDS):
        part = joined[at : at + BLOCK_IDS]
        control, data = encode_block(part)
        out += [np.array([len(part), len(data)], "<u4").tobytes(), control, data]
    return b"".join(out)


def decode_shard(content: bytes, ids_by_rank: np.ndarray) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """(doc_id, pieces of its ids as u32) per document, a block in memory at a time."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    n = int(np.frombuffer(content, "<u4", 1, 4)[0])
    doc_ids = np.frombuffer(content, "<i8", n, 16)
    nulls = np.frombuffer(content, np.uint8, n, 16 + 8 * n)
    counts = np.frombuffer(content, "<u8", n, 16 + 9 * n).astype(np.int64)
    at = 16 + 17 * n
    block, used = np.zeros(0, "<u4"), 0
    for doc_id, null, left in zip(doc_ids.tolist(), nulls.tolist(), counts.tolist()):
        pieces = []
        while left:
            if used == len(block):
                size, length = np.frombuffer(content, "<u4", 2, at).tolist()
                groups = -(-size // 4)
                control = content[at + 8 : at + 8 + groups]
                data = content[at + 8 + groups : at + 8 + groups + length]
                block, used = ids_by_rank[decode_block(size, control, data)], 0
                at += 8 + groups + length
            take = min(left, len(block) - used)
            pieces.append(block[used : used + take])
            used += take
            left -= take
        yield (None if null else doc_id), pieces


def joined_binary(arrays: list[np.ndarray], ends: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each array; ``ends`` begins with 0."""
    data = pa.py_buffer(np.concatenate(arrays).tobytes() if arrays else b"")
    if ends[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(ends.astype("<i4").tobytes()), data])
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def all_ids(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a binary column without nulls, and where each row's begin."""
    _, places, data = column.buffers()
    ends = np.frombuffer(places, "<i4" if column.type == pa.binary() else "<i8")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(dtype).itemsize
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, dtype), ends * 0
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype), (ends - ends[0]) // size


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """part, nth (place in the part), doc_id, ids (binary, u16 or u32) in ascending doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("tokens")
        part, nth, tool = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            ids = tool.encode(batch.column("text").to_pylist(), end_id)
            ends = np.cumsum([0, *(x.nbytes for x in ids)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(nth, nth + len(ids), dtype=np.int64)),
                    batch.column("doc_id"), joined_binary(ids, ends),
                ],
                ["part", "nth", "doc_id", "ids"],
            )
            nth += len(ids)

    ordered = docs.select(F.col("doc_id").cast("long"), fill_text().alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(encode, "part int, nth long, doc_id long, ids binary")


def frequencies(ids: DataFrame, size: int, dtype: str) -> DataFrame:
    """id, n over all documents; a part sends one row per id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            values, _ = all_ids(batch.column("ids"), dtype)
            total += np.bincount(values, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encode all documents into shards under ``folder``, with tables ``ranks`` and ``manifest``.

    The rank table has at most one row per entry of the vocabulary, whatever the input, so
    the driver may hold it and hand it to the tasks.
    """
    ship_package(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    tool = encoder(vocabulary)
    size, dtype = tool.size, tool.dtype.str
    ids = written(tokenised(docs, vocabulary, end_id), "token-ids")
    ranked = [r.id for r in frequencies(ids, size, dtype).orderBy(F.desc("n"), "id").collect()]
    rank_of = np.zeros(size, "<u4")
    rank_of[ranked] = np.arange(len(ranked))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(f"{folder}/shards")
        system.create_dir(root, recursive=True)
        doc_ids, ranks, held, first, last = [], [], 0, None, None

        def close() -> pa.RecordBatch:
            name = f"{first[0]:08d}-{first[1]:012d}-{uuid.uuid4().hex}.fvb"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(encode_shard(doc_ids, ranks))
            n_ids = sum(map(len, ranks))
            return pa.RecordBatch.from_pylist(
                [{"shard": name, "part": first[0], "nth": first[1], "n_docs": len(doc_ids), "n_ids": n_ids}],
                pa.schema([("shard", pa.string()), ("part", pa.int32()), ("nth", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in batches:
            values, bounds = all_ids(batch.column("ids"), dtype)
            values = rank_of[values].astype(dtype)
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "doc_id")), bounds[:-1].tolist(), bounds[1:].tolist())
            for part, nth, doc_id, begin, end in rows:
                if doc_ids and (held >= SHARD_BYTES or (part, nth) != (last[0], last[1] + 1)):
                    yield close()
                    doc_ids, ranks, held = [], [], 0
                if not doc_ids:
                    first = (part, nth)
                doc_ids.append(doc_id)
                ranks.append(values[begin:end])
                held += (end - begin) * values.itemsize
                last = (part, nth)
        if doc_ids:
            yield close()

    docs.sparkSession.createDataFrame([(r, i) for r, i in enumerate(ranked)], "rank long, id long").write.parquet(f"{folder}/ranks")
    manifest = ids.mapInArrow(store, "shard string, part int, nth long, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, u32 binary) of every document in the files."""
    ship_package(spark)
    ranked = [r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    ids_by_rank = np.array(ranked, "<u4")
    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    parts = parts.withColumn("before", F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_ids")
    begins = manifest.withColumn("inside", inside).join(parts, "part").select("shard", (F.col("before") + F.col("inside")).alias("begin"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard, start, rows = path.rsplit("/", 1)[-1], 0, []
                for doc_id, pieces in decode_shard(content.as_py(), ids_by_rank):
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece, crc)
                    n = sum(map(len, pieces))
                    rows.append((shard, doc_id, start, n, crc, b"".join(p.tobytes() for p in pieces) if with_ids else None))
                    start += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["shard", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"],
                )

    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(kinds).option("pathGlobFilter", "*.fvb")
    if manifest.isEmpty():
        rows = spark.createDataFrame([], "shard string, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary")
    else:
        rows = files.load(f"{folder}/shards").select("path", "content").mapInArrow(
            load, "shard string, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary"
        )
    out = rows.join(begins, "shard").select(
        "doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
    return out
