"""Search and page indexes, prediction history, loads that appear as a whole, rejected lines."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from keepsake.operators import views
from keepsake.sources import history, indexes, raw
from keepsake.sources.star_schema import raw_extract, retention_tables
from keepsake.storage import create_once, new_path, small_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return retention_tables(spark, SF)


@pytest.fixture(scope="module")
def odd(spark, tables):
    """Customers with ids of all shapes, some repeated or null."""
    ids = ["Ärger-1", "ab", "a", "", None, "x_y%z", "AbCabcABC", "AbCabcABC", "q" * 500, "abc\\d"]
    row = tables.customers.first().asDict()
    extra = spark.createDataFrame([row | {"customer_id": i} for i in ids], tables.customers.schema)
    return replace(tables, customers=tables.customers.unionByName(extra))


def test_search_by_index_equals_the_scan(spark, odd):
    path = new_path(spark, "search")
    indexes.write_search_index(odd.customers, path)
    for term in ("R#00000_1", "customer", "000000042", "zzz", "abc", "ABCABC", "a%c", "_b_", "x_y", "ärg", "", "q" * 400, "1", "omer#%77", "nothing-like-it"):
        want = [tuple(r) for r in views.search_customers(odd, term, 15).collect()]
        got = [tuple(r) for r in views.hit_profile(odd, indexes.search(spark, path, odd, term, 15)).collect()]
        assert got == want, term


def test_search_reads_only_the_terms_buckets(spark, tables):
    path = new_path(spark, "search")
    indexes.write_search_index(tables.customers, path)
    ids = indexes.indexed_ids(spark, path, "000000042")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert re.search(r"PushedFilters: \[[^\]]*gram", plan)
    assert indexes.grams_of("a_bcd%ef") == ["bcd"] and indexes.indexed_ids(spark, path, "a_b") is None


def test_pages_equal_the_sorted_list(spark, odd):
    whole = odd.customers.filter("customer_id is not null")
    path = new_path(spark, "pages")
    indexes.write_page_index(whole, path, 7)
    n = whole.count()
    want = [r.customer_id for r in whole.orderBy("customer_id").select("customer_id").collect()]
    for limit, offset in ((20, 0), (20, 40), (1, n - 1), (50, n - 10), (5, n), (5, n + 100), (n + 5, 0), (30, 37)):
        assert [r.customer_id for r in indexes.page(spark, path, limit, offset).collect()] == want[offset : offset + limit]
    few = indexes.page(spark, path, 5, 3)
    assert len(few.inputFiles()) > 1  # the table
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*page_range[^\]]*0", plan)


def test_history_keeps_versions_and_repeats_change_nothing(spark):
    path = new_path(spark, "history")
    rows = lambda *r: spark.createDataFrame(r, "customer_id string, churn_probability double")
    assert history.latest_predictions(spark, path) is None
    assert history.append_predictions(rows(("a", 0.1), ("b", 0.2)), path, "1", "v1", "2024-01-01")
    assert history.append_predictions(rows(("a", 0.3)), path, "2", "v2", "2024-01-02")
    assert not history.append_predictions(rows(("a", 0.9)), path, "2", "v2", "2024-01-02")
    assert history.append_predictions(rows(("b", 0.4)), path, "3", "v1", "2023-12-31")  # a late batch
    newest = lambda v=None: {r.customer_id: (r.churn_probability, r.model_version) for r in history.latest_predictions(spark, path, v).collect()}
    assert newest() == {"a": (0.3, "v2"), "b": (0.2, "v1")} and newest("v1") == {"a": (0.1, "v1"), "b": (0.2, "v1")}
    assert history.prediction_history(spark, path).count() == 4
    assert all("/2-" in f for f in history.prediction_history(spark, path, "v2").inputFiles())
    assert history.prediction_history(spark, path, "v3") is None


def test_only_one_writer_creates_a_marker(spark):
    path = new_path(spark, "markers")
    assert small_files(spark, path) == {}
    assert create_once(spark, f"{path}/one", "first") and not create_once(spark, f"{path}/one", "second")
    assert small_files(spark, path) == {"one": "first"}


def test_a_failed_load_leaves_the_old_one(spark, tables):
    path = new_path(spark, "loads")
    with pytest.raises(FileNotFoundError):
        history.snapshot_tables(spark, path)
    few = replace(tables, customers=tables.customers.limit(3))
    assert history.load_snapshot(few, path) == 1
    broken = replace(tables, customer_services=tables.customer_services.withColumn("x", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        history.load_snapshot(broken, path)
    assert history.snapshot_tables(spark, path).customers.count() == 3
    assert history.load_snapshot(tables, path) == 2
    assert history.snapshot_tables(spark, path).customers.count() == tables.customers.count()
    assert history.snapshot_tables(spark, path, 1).customers.count() == 3


def test_accepted_and_rejected_lines_are_all_lines(spark, tmp_path):
    extract = raw_extract(spark, SF)
    names = extract.columns
    good = ",".join(str(v) if v is not None else "" for v in extract.first())
    fields = good.split(",")
    lines = [
        good, ",".join(fields[:-1]), good + ",more", ",".join("many" if n == "tenure" else f for n, f in zip(names, fields)),
        ",".join("" if n == "MonthlyCharges" else f for n, f in zip(names, fields)), '"quoted, id",' + ",".join(fields[1:]), "x",
    ]
    (tmp_path / "lines.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    accepted, rejected = raw.read_raw_checked(spark, str(tmp_path))
    assert accepted.columns == names and accepted.count() == 3 and accepted.filter("customerID = 'quoted, id'").count() == 1
    assert sorted((r.reason, r.line[:1]) for r in rejected.collect()) == sorted([
        ("too few fields", lines[1][:1]), ("too many fields", lines[2][:1]), ("not of its type", lines[3][:1]), ("too few fields", "x"),
    ])
