"""URL filters by a sort-merge range join, in DataFrame functions only.

A host is keyed by its labels in reverse, each followed by a dot (``com.example.www.``), so
that a rule's host and all its subdomains fill the interval from the rule's key up to the
key with its last dot replaced by the next character, a slash. Intervals of hosts nest. The
urls are sorted together with the begins and ends of the intervals; sweeping over them, each
event sets the stack of the rules that are active behind it, and each url takes the stack
of the last event before it. Of the active rules those whose path begins the url's path fit.

Urls are dealt to parts by a hash of the whole row's place, so a host that holds a third of
all rows does not gather anywhere; every part sweeps over all rules' events. The rule list
is repeated once per part, and a part has as many urls as there are events at least.

Nulls: a null url or one without ``://`` has empty host and path, no rule and the default
verdict. Repeated rows stay. An empty rule list gives the default verdict to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.store import spread_parts

#: Urls in a part at least, beyond one part per shuffle task.
PART_URLS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SHAPE, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def interval_events(rules: DataFrame) -> DataFrame:
    """key, kind (0 end, 1 begin) and the stack of rules active behind the event.

    ``rules`` has host, path and verdict. Rules of one host share an interval. The stack is
    found from the keys that begin a rule's key, which are as many as its labels.
    """
    keyed = rules.select(host_key(F.col("host")).alias("key"), F.struct("host", "path", "verdict").alias("rule")).distinct()
    own = keyed.groupBy("key").agg(F.sort_array(F.collect_list("rule")).alias("own"))
    labels = F.split("key", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.when(n == F.size(labels), F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    ))
    chain = own.select("key", F.explode(F.array_distinct(heads)).alias("head"))
    active = chain.join(own.select(F.col("key").alias("head"), "own"), "head").groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("head") != F.col("key"), F.col("own")))).alias("outside"),
    )
    begins = active.select("key", F.lit(1).alias("kind"), F.col("inside").alias("stack"))
    ends = active.filter("key <> ''").select(
        F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("kind"),
        F.col("outside").alias("stack"),
    )
    return begins.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits) and verdict."""
    spark = pages.sparkSession
    n_rules = rules.count()
    parts = spread_parts(spark, pages.count(), max(PART_URLS, 2 * n_rules))
    place = F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), place.alias("part"))
    urls = urls.select(
        "part", host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), "page_id", "host", "path",
        F.expr("cast(null as array<struct<host:string,path:string,verdict:string>>)").alias("stack"),
    )
    events = interval_events(rules).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        "part", "key", "kind", F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack",
    )
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = urls.unionByName(events).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 2")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fits, lambda r: F.struct(
        F.length(F.concat(r["host"], r["path"])).alias("size"), F.length(r["host"]).alias("host_size"),
        F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"),
    ))
    best = swept.withColumn("best", F.array_max(ranked))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
