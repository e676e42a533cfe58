"""Stored indexes over customers: trigrams for substring search, id ranges for deep pages.

Search. Postings (trigram, customer_id) lie in one folder per bucket of trigrams, sorted by
trigram, so a term reads the row groups of its own trigrams only. Rows are range-dealt by
(bucket, trigram, customer_id), so a trigram that every id holds is split over tasks. The
table of trigram counts tells which postings are short: the rarest few of the term are
intersected, and the ids that hold all of them are checked with the pattern itself.

Pages. Customers lie in ranges of customer_id of about equal size, one folder each, with a
table of the rows per range. An offset is one sum over that table; only the ranges that the
page touches are read, and only their rows meet in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.schema import Tables, literal_rows

GRAM, BUCKETS, RAREST = 3, 64, 4


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_search_index(customers: DataFrame, path: str) -> None:
    """Postings and counts of all trigrams of the lower-cased customer_id. Ids that are null or
    shorter than a trigram have none."""
    low = F.lower("customer_id")
    places = F.sequence(F.lit(1), F.length("customer_id") - (GRAM - 1))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))
    long_enough = customers.filter(F.length(low) >= GRAM).filter(F.length("customer_id") >= GRAM)
    postings = long_enough.select("customer_id", F.explode(grams).alias("gram")).filter(F.length("gram") == GRAM)
    dealt = postings.withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "customer_id")
    dealt.sortWithinPartitions("bucket", "gram", "customer_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = customers.sparkSession.read.schema("customer_id string, gram string, bucket int").parquet(f"{path}/postings")
    stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def grams_of(term: str) -> list[str]:
    """Trigrams that every match of a term holds: those of its stretches without wildcards."""
    runs = re.split(r"[%_\\]", term.lower())
    return sorted({r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})


def indexed_ids(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """Ids that hold the rarest trigrams of a term; None if the term has no trigram."""
    grams = grams_of(term)
    if not grams:
        return None
    counts = spark.read.schema("gram string, n long").parquet(f"{path}/counts").filter(F.col("gram").isin(grams))
    found = {r["gram"]: r["n"] for r in counts.collect()}  # at most one row per trigram of the term
    postings = spark.read.schema("customer_id string, gram string, bucket int").parquet(f"{path}/postings")
    if len(found) < len(grams):
        return postings.select("customer_id").filter(F.lit(False))
    rarest = sorted(grams, key=lambda g: (found[g], g))[:RAREST]
    named = literal_rows(spark, [(g,) for g in rarest], ["gram"])
    buckets = [r["bucket"] for r in named.select(_bucket(F.col("gram")).alias("bucket")).collect()]
    kept = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(rarest))
    return kept.groupBy("customer_id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rarest)).select("customer_id")


def search(spark: SparkSession, path: str, tables: Tables, term: str, limit: int = 20) -> DataFrame:
    """The first customers whose id matches a term anywhere, case-insensitively, % and _ being
    wildcards. A term without three plain characters in a row is looked for in all ids."""
    matches, found = F.col("customer_id").ilike(f"%{term}%"), tables.customers
    ids = indexed_ids(spark, path, term)
    if ids is not None:
        first = ids.filter(matches).orderBy("customer_id").limit(limit)
        found = found.join(first, "customer_id", "left_semi")
    return found.filter(matches).orderBy("customer_id").limit(limit)


def write_page_index(customers: DataFrame, path: str, ranges: int) -> None:
    """Customers in ``ranges`` ranges of customer_id, and the rows before each range."""
    placed = customers.repartitionByRange(ranges, "customer_id").withColumn("page_range", F.spark_partition_id())
    placed.sortWithinPartitions("customer_id").write.mode("overwrite").partitionBy("page_range").parquet(f"{path}/rows")
    stored = customers.sparkSession.read.parquet(f"{path}/rows")
    counts = stored.groupBy("page_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("page_range")) - F.col("n")  # a row per range
    counts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def page(spark: SparkSession, path: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of customer_id."""
    ranges = spark.read.parquet(f"{path}/ranges")
    touched = ranges.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    kept = rows.filter(F.col("page_range").isin([r["page_range"] for r in touched])).drop("page_range")
    skip = offset - min((r["before"] for r in touched), default=offset)
    return kept.orderBy("customer_id").offset(skip).limit(limit)
