from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.functions import ranking


def skewed(spark, n: int):
    """A third of the rows share one value; some values are missing."""
    return spark.range(n).select(
        F.format_string("c%05d", (F.col("id") * 7919) % 100003).alias("customer_id"),
        F.when(F.col("id") % 3 == 0, 42.5)
        .when(F.col("id") % 17 == 0, F.lit(None))
        .otherwise((F.col("id") * 31) % 97 + 0.25)
        .alias("value"),
    )


@pytest.mark.parametrize("n,k", [(1, 4), (3, 5), (5, 4), (97, 4), (1502, 5), (7043, 4)])
def test_ntile_equals_window(spark, n, k):
    df = skewed(spark, n)
    got = ranking.add_ntiles(df, k, {"up": F.col("value"), "down": -F.col("value")}, "customer_id")
    want = df.select(
        "customer_id",
        F.ntile(k).over(W.orderBy("value", "customer_id")).alias("up"),
        F.ntile(k).over(W.orderBy(F.desc_nulls_first("value"), "customer_id")).alias("down"),
    )
    assert sorted(got.select("customer_id", "up", "down").collect()) == sorted(want.collect())


def test_ntile_of_nothing(spark):
    assert ranking.add_ntiles(skewed(spark, 0), 4, {"t": F.col("value")}, "customer_id").count() == 0


def test_rank_equals_window(spark):
    df = skewed(spark, 1502)
    got = ranking.add_rank(df, -F.col("value"), "r").select("customer_id", "r")
    want = df.select("customer_id", F.rank().over(W.orderBy(F.desc_nulls_first("value"))).alias("r"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_positions_equal_row_number(spark):
    df = skewed(spark, 1502)
    got = ranking.global_positions(df, ["value", "customer_id"]).select("customer_id", "position")
    want = df.select("customer_id", F.row_number().over(W.orderBy("value", "customer_id")).alias("position"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("n", [5, 100, 7043])
def test_first_rank_quartile_equals_pandas(spark, n):
    df = skewed(spark, n).fillna(0.0)
    got = ranking.add_first_rank_quartile(df, "value", "customer_id", "q").toPandas().set_index("customer_id")["q"]
    pdf = df.toPandas().sort_values("customer_id").set_index("customer_id")
    want = pd.qcut(pdf["value"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    assert (got.sort_index() == want).all()


def test_value_quartile_equals_pandas(spark):
    df = spark.range(1503).select(
        F.col("id").cast("string").alias("customer_id"), ((F.col("id") * 37) % 1009 / 7.0).alias("value")
    )
    got = ranking.add_value_quartile(df, "value", "q").toPandas().set_index("customer_id")["q"]
    pdf = df.toPandas().set_index("customer_id")
    want = pd.qcut(pdf["value"], 4, labels=[1, 2, 3, 4]).astype(int)
    assert (got.sort_index() == want.sort_index()).all()


def test_quantiles_equal_numpy(spark):
    df = skewed(spark, 1001)
    values = np.array([r[0] for r in df.select("value").collect() if r[0] is not None])
    got = ranking.exact_quantiles(df, {"v": (F.col("value"), [0.0, 0.1, 0.5, 0.75, 1.0])})["v"]
    assert np.allclose(got, np.quantile(values, [0.0, 0.1, 0.5, 0.75, 1.0]), rtol=0, atol=1e-12)


def test_running_totals(spark):
    counts = skewed(spark, 1502).groupBy("value").count()
    got = ranking.running_totals(counts, ["value"], ["count"]).orderBy("value").toPandas()
    assert (got["count_through"] == got["count"].cumsum()).all()
    assert (got["count_before"] == got["count"].cumsum() - got["count"]).all()


@pytest.mark.parametrize("kind,values", [
    ("long", [2**53, 2**53 + 1, 2**53 + 1, None, -5, 2**53 - 1]),
    ("decimal(38,2)", ["10000000000000000000.01", "10000000000000000000.02", "10000000000000000000.02", None, "-1", "0"]),
    ("date", ["2024-01-02", "2024-01-01", "2024-01-02", None, "1999-12-31", "2030-01-01"]),
    ("string", ["b", "a", "b", None, "", "zz"]),
])
def test_ranks_and_tiles_of_native_types(spark, kind, values):
    from pyspark.sql import Window

    rows = [(i, None if v is None else str(v)) for i, v in enumerate(values * 4)]
    df = spark.createDataFrame(rows, "id int, v string").withColumn("v", F.col("v").cast(kind))
    one_task = Window.orderBy(F.col("v").asc_nulls_first())
    want = {r["id"]: (r["r"], r["t"]) for r in df.select(
        "id", F.rank().over(one_task).alias("r"), F.ntile(5).over(Window.orderBy(F.col("v").asc_nulls_first(), "id")).alias("t")
    ).collect()}
    ranked = ranking.add_rank(df, F.col("v"), "r")
    got = ranking.add_ntiles(ranked, 5, {"t": F.col("v")}, "id").collect()
    assert {r["id"]: (r["r"], r["t"]) for r in got} == want


def test_ranks_with_a_hot_value_and_without_adaptive_execution(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
        got = {r["id"]: r["r"] for r in ranking.add_rank(df, F.col("v"), "r").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    order = sorted(7 if i % 3 == 0 else i for i in range(3000))
    first = {v: order.index(v) + 1 for v in set(order)}
    assert got == {i: first[7 if i % 3 == 0 else i] for i in range(3000)}


@pytest.mark.parametrize("values", [[], [None, None]])
def test_quantiles_of_nothing(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranking.exact_quantiles(df, {"v": (F.col("v"), [0.25, 0.5])}) == {"v": [None, None]}
