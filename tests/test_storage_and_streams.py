from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keepsake import storage
from keepsake.operators import explain, features, scoring, views
from keepsake.plans.fixed_model import fixed_model
from keepsake.sources import quality, raw, sinks
from keepsake.sources.star_schema import AS_OF, raw_extract, retention_tables
from keepsake.streaming import online

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def requests(spark):
    base = views.feature_base(retention_tables(spark, SF))
    return features.profile_to_request(base).persist()


def test_shared_folder_is_the_sessions_own(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark)
    assert named is None or folder == named
    assert storage.new_path(spark, "x").startswith(folder.rstrip("/"))
    assert storage.new_path(spark, "x") != storage.new_path(spark, "x")


def test_cluster_without_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())


def test_ingest_equals_normalised_tables(spark):
    ours = raw.ingest(raw_extract(spark, SF), AS_OF)
    given = retention_tables(spark, SF)
    columns = given.customers.columns
    known = given.customers.filter("total_charges IS NOT NULL")
    assert known.exceptAll(ours.customers.select(columns)).count() == 0
    # the given tables lack some customers' rows, repeat some and hold rows of former customers
    still = ~F.col("customer_id").startswith("Former")
    subscribed = given.customer_services.filter("is_subscribed").filter(still).distinct()
    assert subscribed.exceptAll(ours.customer_services).count() == 0
    number = F.substring("customer_id", -9, 9).cast("int")
    lacking = (number % 47 == 3) | (number % 89 == 11)
    assert ours.customer_services.exceptAll(subscribed).filter(~lacking).count() == 0
    assert given.customer_contracts.filter(still).exceptAll(
        ours.customer_contracts.select(given.customer_contracts.columns)
    ).count() == 0


def test_load_tables_replaces(spark, tmp_path):
    tables = retention_tables(spark, SF)
    for _ in range(2):
        sinks.load_tables(tables, str(tmp_path))
    counts = {r["table_name"]: r["row_count"] for r in quality.table_counts(sinks.stored_tables(spark, str(tmp_path))).collect()}
    assert counts["customers"] == 150 and counts["customer_contracts"] == tables.customer_contracts.count() < 150


def test_predictions_are_partitioned_by_level(spark, requests, tmp_path):
    scored = explain.top_reasons(scoring.score_requests(requests, fixed_model()), fixed_model())
    sinks.write_predictions(scoring.to_predictions(scored, "v1", AS_OF, F.col("top_reasons")), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == scored.count()
    assert {r["risk_level"] for r in back.select("risk_level").distinct().collect()} <= {"low", "medium", "high"}
    assert (tmp_path / "p").joinpath("risk_level=high").exists()
    assert back.selectExpr("size(top_factors) AS n").distinct().collect()[0]["n"] == 3


def test_query_with_parameters(spark):
    customers = retention_tables(spark, SF).customers
    got = sinks.query_table(
        spark, "SELECT count(*) AS n FROM {c} WHERE tenure_months <= :t", {"t": 6}, c=customers
    )
    assert got.first()["n"] == customers.filter("tenure_months <= 6").count()


def test_stream_equals_batch_across_restarts(spark, requests, tmp_path):
    model = fixed_model()
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    whole = online.respond(requests, model)
    for part in range(3):
        requests.filter(F.pmod(F.xxhash64("customer_id"), F.lit(3)) == part).write.mode("append").json(source)
        arriving = online.request_stream(spark, source)
        assert arriving.isStreaming
        online.start_scoring(arriving, model, out, mark, once=True).awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == whole.count() > 0
    assert back.exceptAll(whole).count() == 0


def test_running_summary_across_restarts(spark, requests, tmp_path):
    model = fixed_model()
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for part in range(2):
        requests.filter(F.pmod(F.xxhash64("customer_id"), F.lit(2)) == part).write.mode("append").json(source)
        online.start_summary(online.request_stream(spark, source), model, out, mark, once=True).awaitTermination()
    want = scoring.batch_summary(scoring.score_requests(requests, model))
    got = online.latest_summary(spark, out)
    assert got.exceptAll(want).count() == 0 and got.count() == 4
