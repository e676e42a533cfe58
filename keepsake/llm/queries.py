"""Registered queries of this subpackage, with SQL where SQL can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import (
    alignment, embedding_dedup, jaccard, language, mixing, neighbours, packing, runs, substring, token_counts,
    token_files, url_rules, warc,
)
from keepsake.llm.store import new_path, table, written
from keepsake.schema import literal_rows

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_slot", "mix_start")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(spark, folder)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", (language.fold_of(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, URL_RULES, ["host", "path", "verdict"])
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: A word, as the operators split texts.
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of signs that the cleaning before the third batch takes out.
SIGN_RUNS = "[*%$&#!]{2,}"


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of ``counted_batches`` under the public vocabularies and a rule of words."""
    return counted_batches(spark, table(spark, sf_dir, "documents"), token_counts.VERSIONS)


def rollup_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under rules that SQL can state."""
    return counted_batches(spark, table(spark, sf_dir, "documents"), token_counts.PATTERNS)


def counted_batches(spark: SparkSession, docs: DataFrame, versions: dict) -> DataFrame:
    """Three batches over all documents: all inserted, exact copies deleted, cleaned texts
    revised; the last two are sent twice, as after a lost answer. Rows without a doc_id can't
    be deleted or revised later, so they are made unique and cleaned before their insert."""
    nameless, docs = docs.filter("doc_id is null"), docs.filter("doc_id is not null")
    first = docs.groupBy(F.xxhash64("text"), F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    gone = docs.select("doc_id").join(first, "doc_id", "left_anti").select(
        F.lit("delete").alias("op"), "doc_id", F.explode(F.array(*map(F.lit, versions))).alias("version"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n_tokens"),
    )
    cleaned = docs.filter(F.regexp_like("text", F.lit(SIGN_RUNS))).withColumn("text", F.regexp_replace("text", SIGN_RUNS, ""))
    revised = token_counts.counts(cleaned, versions).join(first, "doc_id", "left_semi").withColumn("op", F.lit("revise"))
    store = token_counts.Rollup(spark, new_path(spark, "token-counts"))
    inserted = token_counts.counts(docs, versions)
    if not nameless.isEmpty():
        held = docs.select(F.xxhash64("text").alias("a"), F.md5("text").alias("b"))
        keyed = nameless.withColumns({"a": F.xxhash64("text"), "b": F.md5("text")}).dropDuplicates(["a", "b"])
        alone = keyed.alias("l").join(held.alias("r"), (F.col("l.a") == F.col("r.a")) & F.col("l.b").eqNullSafe(F.col("r.b")), "left_anti")
        inserted = inserted.unionByName(token_counts.counts(alone.withColumn("text", F.regexp_replace("text", SIGN_RUNS, "")), versions))
    store.commit("0001", inserted.withColumn("op", F.lit("insert")))
    store.compact()
    for _ in range(2):
        store.commit("0002", gone)
        store.commit("0003", revised)
    return store.totals()


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), arcs)
    warc.convert(spark, arcs, warcs, least=0)
    records = warc.with_referred_keys(written(warc.read_warc(spark, warcs), "warc-records"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = written(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return alignment.scored(aligned).select("doc_id", *figures)


def planted_runs(docs: DataFrame) -> DataFrame:
    """In about a tenth of the documents, chosen by a hash of doc_id, the words repeat from some
    word on; the others, and those without a doc_id or a text, are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        moved = F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(moved, " "))

    split = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))  # in an array, so that words are split once
    text = F.when(h % 10 == 0, F.coalesce(F.get(F.transform(split, repeated), F.lit(0)), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    first = F.get(F.array_sort("runs", runs.stronger), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    best = found.withColumn("best", first)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_token_files": op2_token_files,
        "op3_packing": op3_packing,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_language": op5_language,
        "op6_url_rules": op6_url_rules,
        "op7_neighbours": op7_neighbours,
        "op8_substring": op8_substring,
        "op9_token_counts": op9_token_counts,
        "rollup_by_rule": rollup_by_rule,
        "op10_jaccard": op10_jaccard,
        "op11_warc": op11_warc,
        "op12_alignment": op12_alignment,
        "op13_runs": op13_runs,
    }


def statements() -> dict[str, str]:
    from keepsake.llm import oracle

    return oracle.statements()
