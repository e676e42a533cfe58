"""Language identification in two levels: family first, then the language within it.

A text is lower-cased and all but its letters become spaces; its features are the shares of
its hashed runs of two, three and four bytes. One linear support vector machine per pair of
families votes for the family, one per pair of languages of that family for the language.
All machines are rows of one weight matrix, so predicting is one pass of table lookups over
the whole text. The machines are fitted on a bounded sample of labelled texts, at most
PER_LANGUAGE per language and SAMPLE in all, by one task; everything else covers all rows.

Nulls and ties: a text that is null or has no letter is ``und`` with score 0; equal votes go
to the larger sum of margins, then to the first name. Without labelled texts every text is
``und`` with score 0; with one language every text with a letter is of it, with score 1.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.llm.store import ship_package, use_memory

UNKNOWN = "und"
PER_LANGUAGE, SAMPLE = 400, 2000
#: Lengths of the byte runs, and bits of the table that each length has.
RUNS, BITS = (2, 3, 4), 11
DIMENSIONS = len(RUNS) << BITS
#: Bytes of text that are looked up at once, and rows that are taken from a batch at once.
CHUNK, ROWS = 1 << 20, 1000

#: Families of languages by ISO 639-1 code. Other codes share one family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}

#: What _LETTER finds, and what it doesn't, for Spark's expressions.
LETTER, NO_LETTER = r"[\p{L}\p{Nl}\p{No}]", r"[^\p{L}\p{Nl}\p{No}]+"
#: Labelled texts of the held-out fold that limits come from, the share of the least letters of
#: right ones that is a floor, and the quantile of their scores from which a score is sure.
HELD_OUT, SLACK, LEAST = 2000, 0.9, 0.02
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), "other")


def cleaned(text: str | None) -> bytes:
    """Letters in lower case, words parted by one space, a space at both ends."""
    if not text or not _LETTER.search(text):
        return b""
    return f" {_NOT_LETTER.sub(' ', text.lower()).strip()} ".encode()


def run_codes(data: np.ndarray) -> list[np.ndarray]:
    """By length: the table row of the run of bytes that begins at each place."""
    out, packed = [], data.astype(np.uint32)
    for i, size in enumerate(RUNS):
        n = max(len(data) - size + 1, 0)
        code = np.zeros(n, np.uint32)
        for k in range(size):
            code = (code << np.uint32(8)) | packed[k : k + n]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out.append(code.astype(np.intp) + (i << BITS))
    return out


def shares(text: bytes) -> np.ndarray:
    """The feature vector of one cleaned text."""
    out = np.zeros(DIMENSIONS, np.float32)
    codes = run_codes(np.frombuffer(text, np.uint8))
    for code in codes:
        out += np.bincount(code, minlength=DIMENSIONS)
    return out / max(sum(map(len, codes)), 1)


def margins(texts: list[bytes], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Texts by machines: bias plus the mean weight over the text's runs."""
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), lengths)
    total = np.zeros((len(texts), weights.shape[1]))
    for size, codes in zip(RUNS, run_codes(data)):
        inside = owner[: len(codes)] == owner[size - 1 :] if len(codes) else np.zeros(0, bool)
        codes, at = codes[inside], owner[: len(codes)][inside]
        for m in range(weights.shape[1]):
            total[:, m] += np.bincount(at, weights[codes, m], minlength=len(texts))
    n = sum(np.maximum(lengths - size + 1, 0) for size in RUNS)
    return bias + total / np.maximum(n, 1)[:, None]


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by dual descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    square = (x * x).sum(1) + 0.5 / cost
    order = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            now = max(alpha[i] - slope / square[i], 0.0)
            if now != alpha[i]:
                w += (now - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(now - alpha[i]))
                alpha[i] = now
        if moved < 1e-3 * max(alpha.max(), 1e-9):
            break
    return w


class Model:
    """Pairs of families and of languages with their machines."""

    def __init__(self, langs: list[str], features: np.ndarray, labels: np.ndarray):
        self.langs = langs
        self.families = sorted({family_of(x) for x in langs})
        of = np.array([family_of(x) for x in langs])[labels] if len(labels) else np.zeros(0, str)
        scale = (1 / np.sqrt(features.mean(0) + 1e-6) if len(features) else np.ones(DIMENSIONS)).astype(np.float32)
        scaled, named = features * scale, np.array(langs, object)[labels] if len(labels) else np.zeros(0, object)
        pairs = [(f, g, of) for f, g in combinations(self.families, 2)]
        for family in self.families:
            pairs += [(a, b, named) for a, b in combinations([x for x in langs if family_of(x) == family], 2)]
        columns = []
        for a, b, kinds in pairs:
            chosen = (kinds == a) | (kinds == b)
            w = fit_machine(scaled[chosen], np.where(kinds[chosen] == a, 1.0, -1.0))
            columns.append(np.append(w[:-1] * scale, w[-1]))
        self.pairs = [(a, b) for a, b, _ in pairs]
        matrix = np.array(columns).T if columns else np.zeros((DIMENSIONS + 1, 0))
        self.weights, self.bias = np.ascontiguousarray(matrix[:-1]).astype(np.float32), matrix[-1]

    def _choose(self, names: list[str], margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes, and the mean of its machines' probabilities."""
        votes, sums, odds = (np.zeros((len(margin), len(names))) for _ in range(3))
        for a, b in combinations(names, 2):
            m = margin[:, self.pairs.index((a, b))]
            for name, side in ((a, m), (b, -m)):
                i = names.index(name)
                votes[:, i] += side >= 0 if name == a else side > 0
                sums[:, i] += side
                odds[:, i] += 1 / (1 + np.exp(np.clip(-2 * side, -50, 50)))
        top = votes.max(1, keepdims=True)
        best = np.where(votes == top, sums, -np.inf).argmax(1)
        return best, odds[np.arange(len(best)), best] / max(len(names) - 1, 1) if len(names) > 1 else np.ones(len(best))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [cleaned(t) for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        where = [i for i, t in enumerate(clean) if t]
        if not self.langs or not where:
            return names, scores
        parts, held, begin = [], 0, 0
        for end, i in enumerate(where, 1):
            held += len(clean[i])
            if held >= CHUNK or end == len(where):
                parts.append(margins([clean[j] for j in where[begin:end]], self.weights, self.bias))
                begin, held = end, 0
        margin = np.concatenate(parts)
        family, sure = self._choose(self.families, margin)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            langs = [x for x in self.langs if family_of(x) == name]
            best, odds = self._choose(langs, margin[rows])
            for row, k, p in zip(rows, best, odds * sure[rows]):
                names[where[row]], scores[where[row]] = langs[k], float(p)
        return names, scores


def fold_of(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame) -> Model:
    """Fit on a hash-chosen sample of the labelled rows whose fold is not 2."""
    ship_package(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    known = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(known)
    if not langs:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int))
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(langs)))
    rank = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    shares_by = F.create_map(*[F.lit(v) for lang in langs for v in (lang, 1.5 * each / known[lang] + 20 / known[lang])])
    chosen = labelled.withColumn("rank", rank).filter(F.col("rank") < shares_by[F.col("lang")]).select("lang", "rank", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cleaned(t) for t in batch.column("text").to_pylist()]
            rows = [shares(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("rank"), pa.array(rows, pa.binary()), pa.array([bool(t) for t in texts])],
                ["lang", "rank", "x", "ok"],
            )

    def learn(sample: pa.Table) -> pa.Table:
        names, ranks = sample.column("lang").to_pylist(), sample.column("rank").to_pylist()
        order = sorted(range(len(names)), key=lambda i: (ranks[i], names[i], sample.column("place")[i].as_py()))
        found = sorted(set(names))
        x = np.zeros((len(order), DIMENSIONS), np.float32)
        for row, i in enumerate(order):
            x[row] = np.frombuffer(sample.column("x")[i].as_buffer(), np.float32)
        del sample
        model = Model(found, x, np.array([found.index(names[i]) for i in order], int))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    made = chosen.mapInArrow(features, "lang string, rank double, x binary, ok boolean").filter("ok").drop("ok")
    first = made.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("rank", "x"))).filter(F.col("place") <= each)
    # The sample stays on the executors: the driver gets the machines only.
    learned = first.groupBy().applyInArrow(learn, "model binary").first()
    return pickle.loads(learned.model) if learned else Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred and score; only the text is read for them. Columns of
    these names in the input are replaced."""
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("language")
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                names, scores = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*part.schema.names, "lang_pred", "score"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def letter_share(text) -> F.Column:
    """Letters among the characters of a text that are not spaces."""
    return F.length(F.regexp_replace(text, NO_LETTER, "")) / F.length(F.regexp_replace(text, r"\s+", ""))


def limits(docs: DataFrame, model: Model) -> tuple[float, float]:
    """The floors of letter share and of sure scores, from right predictions for a
    hash-chosen bounded sample of the labelled held-out fold; without any, both are 0."""
    held = docs.filter(F.col("lang").isin(model.langs) & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) == 2))
    n = held.count()
    rank = F.pmod(F.xxhash64("doc_id", F.lit("limits")), F.lit(1 << 30)) / float(1 << 30)
    chosen = held.filter(rank < HELD_OUT / max(n, 1)).select("lang", "text")
    right = identify(chosen, model).filter("lang_pred = lang").agg(
        F.min(letter_share(F.col("text"))).alias("letters"), F.percentile("score", F.lit(LEAST)).alias("least")
    ).first()
    return (0.0, 0.0) if right.least is None else (SLACK * right.letters, right.least)
