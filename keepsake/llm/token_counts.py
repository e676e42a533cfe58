"""Token counts as rollups that batches of signed changes keep up to date.

The store has one folder per committed batch with signed ledger rows (what a document
counted under a tokenizer version, +1 when it begins to count and -1 when it ends; equal
rows without a doc_id are one ledger row whose sign is their number) and the
signed sums of these rows by source, language and version. A revision is a -1 of the old
row and a +1 of the new one. Totals are the sum over the committed batches, so they cost as
much as the sums, not as the documents. A batch is committed by a small file that only one
writer can create and that names the folder of its rows: a batch that has one is not applied
again, and a folder that a failed or a second attempt left is never read. ``compact`` folds
all batches so far into one ledger and one table of sums, which later commits start from.

A tokenizer version is a vocabulary file of public tokenizers, or a pattern of tokens.

Nulls, repeats, odd rows: a null or empty text has no token; texts are counted as a whole, so
memory grows with the longest one; other columns are ignored; an empty batch changes nothing; a null source or language is a group of its own; rows with a null doc_id
can't be found again: each insert of one counts as a document of its own, also in the same
batch, and their revisions and deletes do nothing; a document that is inserted twice in a batch counts once (the largest n_tokens), a second insert of a
known document is a revision, and deletes of unknown documents do nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.store import discard, memory, ship_package, use_memory, written
from keepsake.llm.tokens import Remembered, encoder, grouped, pieces_of
from keepsake.storage import create_once, small_files

LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, sign long"
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
KEYS = ("source", "lang", "version")


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file: of the tokenizers library (.json) or of sentencepiece (.model)."""

    name: str
    path: str | None = None

    def file(self) -> str:
        if self.path:
            return self.path
        import public_tokenizers

        return public_tokenizers.path(self.name)


#: Counting rules by tokenizer version.
VERSIONS: dict[str, Vocabulary | str] = {
    "byte-bpe-50k": Vocabulary("byte_bpe_50k.json"),
    "piece-bpe-32k": Vocabulary("piece_bpe_32k.model"),
    "words-1": r"[^\x20\x09-\x0D]+",
}
#: Versions that are patterns only.
PATTERNS: dict[str, Vocabulary | str] = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]",
}


class PieceCounter:
    """Counts a sentencepiece vocabulary's tokens, each distinct piece of many texts once."""

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size()))
        self.by_pieces = not any("▁" in n.lstrip("▁") for n in names)
        self.known = Remembered(lambda pieces: [len(ids) for ids in self.tool.encode(pieces, num_threads=1)])
        memory("counts", self.known.clear)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_pieces:
            return [len(ids) for ids in self.tool.encode(texts, num_threads=1)]
        out: list[int] = []
        for group in grouped(texts):
            pieces, numbers, bounds = pieces_of(group)
            sizes = np.array(self.known.of(pieces, np.bincount(numbers, minlength=len(pieces))), np.int64)
            total = np.concatenate([[0], np.cumsum(sizes[numbers])])
            out += (total[bounds[1:]] - total[bounds[:-1]]).tolist()
        return out


@lru_cache(maxsize=4)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def counts(docs: DataFrame, versions: dict[str, Vocabulary | str] | None = None) -> DataFrame:
    """doc_id, source, lang, version, n_tokens: one row per document and version."""
    versions = VERSIONS if versions is None else versions
    files = {v: r.file() for v, r in versions.items() if isinstance(r, Vocabulary)}
    text = F.coalesce("text", F.lit(""))
    patterns = [
        F.struct(F.lit(v).alias("version"), F.regexp_count(text, F.lit(p)).cast("long").alias("n_tokens"))
        for v, p in versions.items() if isinstance(p, str)
    ]
    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", text.alias("text"), F.array(*patterns).alias("counted"))
    if files:
        ship_package(docs.sparkSession)
        kinds = "doc_id long, source string, lang string, version string, n_tokens long"

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            use_memory("counts")
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for version, path in files.items():
                    if path.endswith(".model"):
                        found = _counter(path).counts(texts)
                    else:
                        found = [len(ids) for ids in encoder(path).encode(texts)]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(texts)), pa.array(found, pa.int64())],
                        ["doc_id", "source", "lang", "version", "n_tokens"],
                    )

        tokenised = rows.select("doc_id", "source", "lang", "text").mapInArrow(count, kinds)
        if not patterns:
            return tokenised
        return tokenised.unionByName(rows.select("doc_id", "source", "lang", F.inline("counted")))
    return rows.select("doc_id", "source", "lang", F.inline("counted"))


class Rollup:
    """A rollup store under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> dict[str, str]:
        return small_files(self.spark, f"{self.folder}/commits")

    def batches(self) -> list[str]:
        return sorted(self._commits())

    def _folders(self) -> list[str]:
        """The folders to read: the largest compaction and the batches it does not hold."""
        folded = [json.loads(text) for text in small_files(self.spark, f"{self.folder}/compactions").values()]
        base = max(folded, key=lambda c: len(c["batches"]), default={"batches": [], "folder": None})
        later = [folder for batch, folder in sorted(self._commits().items()) if batch not in base["batches"]]
        return ([base["folder"]] if base["folder"] else []) + later

    def compact(self) -> None:
        """Fold all committed batches into one ledger and one table of sums."""
        done, attempt = self.batches(), f"rows-{uuid.uuid4().hex}"
        self.ledger().withColumnRenamed("n_rows", "sign").select(*[c.split()[0] for c in LEDGER.split(", ")]).write.parquet(f"{self.folder}/{attempt}/ledger")
        self.totals().write.parquet(f"{self.folder}/{attempt}/deltas")
        create_once(self.spark, f"{self.folder}/compactions/{uuid.uuid4().hex}", json.dumps({"folder": attempt, "batches": done}))

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = [f"{self.folder}/{f}/{kind}" for f in self._folders()]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What counts now: the signed rows that are not taken back, with ``n_rows``, which
        is above 1 only for equal rows without a doc_id."""
        rows = self._read("ledger", LEDGER).groupBy("doc_id", "version", "source", "lang", "n_tokens")
        return rows.agg(F.sum("sign").alias("n_rows")).filter("n_rows > 0")

    def totals(self) -> DataFrame:
        sums = self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied.

        ``changes``: op (insert, revise or delete), doc_id, version, source, lang, n_tokens;
        a delete needs doc_id and version only. One change per document and version counts,
        and every insert without a doc_id.
        """
        if batch in self.batches():
            return False
        changes = written(changes, "count-changes")  # read twice below, and counting tokens is dear
        one = F.max_by(F.struct("op", "source", "lang", "n_tokens"), F.struct(F.coalesce("n_tokens", F.lit(-1)), "op", "source", "lang"))
        asked = changes.filter("doc_id is not null").groupBy("doc_id", "version").agg(one.alias("c")).select("doc_id", "version", "c.*", F.lit(1).alias("asked"))
        known = self.ledger().filter("doc_id is not null").select("doc_id", "version", *[F.col(c).alias(f"old_{c}") for c in ("source", "lang", "n_tokens")])
        met = asked.join(known, ["doc_id", "version"], "left")
        old = F.struct(
            "doc_id", "version", F.col("old_source").alias("source"), F.col("old_lang").alias("lang"),
            F.col("old_n_tokens").alias("n_tokens"), F.lit(-1).cast("long").alias("sign"),
        )
        new = F.struct("doc_id", "version", "source", "lang", F.col("n_tokens"), F.lit(1).cast("long").alias("sign"))
        was, stays = F.col("old_n_tokens").isNotNull(), (F.col("op") != "delete") & F.col("n_tokens").isNotNull()
        signed = met.select(F.inline(F.filter(
            F.array(F.when(was, old), F.when(stays, new)), lambda r: r.isNotNull()
        )))
        nameless = changes.filter("doc_id is null and op = 'insert' and n_tokens is not null").select(
            F.lit(None).cast("long").alias("doc_id"), "version", "source", "lang", F.col("n_tokens").cast("long").alias("n_tokens")
        )
        signed = signed.unionByName(nameless.groupBy(*nameless.columns).agg(F.count("*").alias("sign")))
        attempt = f"rows-{uuid.uuid4().hex}"
        signed.write.parquet(f"{self.folder}/{attempt}/ledger")
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/{attempt}/ledger")
        sums = rows.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.folder}/{attempt}/deltas")
        discard(changes)
        return create_once(self.spark, f"{self.folder}/commits/{batch}", attempt)
