"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions import bands, ranking
from keepsake.functions.metrics import count_if
from keepsake.operators import (
    analytics, evaluate, explain, features as feat, histogram_trees, path_attribution, reports, resampling, scoring,
    serving, splits, training, trees, validation, views,
)
from keepsake.plans import job
from keepsake.plans.fixed_model import fixed_model
from keepsake.plans.oracle import GROUPS
from keepsake.schema import FEATURES, Tables, literal_rows
from keepsake.sources import history, indexes, quality, raw, sinks
from keepsake.sources.star_schema import AS_OF, raw_extract, raw_shape, retention_tables
from keepsake.storage import new_path
from keepsake.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
CUSTOMER = "Customer#000000042"


def portable(df: DataFrame) -> DataFrame:
    """Engine-neutral types: bigint counts, double numbers, ISO text dates."""

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def _on_tables(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: portable(operator(retention_tables(spark, sf_dir)))


def _on_raw(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: portable(operator(raw_extract(spark, sf_dir)))


def _on_scored(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_tables(lambda t: operator(scoring.scored_customers(t, fixed_model())))


def _on_requests(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_tables(lambda t: operator(feat.profile_to_request(views.feature_base(t))))


# --- sources, cleaning, sinks -----------------------------------------------------------------


def _read_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "raw-extract")
    shaped = raw_extract(spark, sf_dir)
    shaped.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return portable(raw.read_raw(spark, path))


def _lower_cleaned(df: DataFrame) -> DataFrame:
    return raw.normalise_columns(df)


def _lookup_use(t: Tables) -> DataFrame:
    contracts = t.customer_contracts.groupBy("contract_type_id").agg(F.count(F.lit(1)).alias("used"))
    services = t.customer_services.groupBy("service_type_id").agg(F.count(F.lit(1)).alias("used"))
    return (
        t.contract_types.join(contracts, "contract_type_id", "left")
        .select(
            F.lit("contract").alias("lookup"), F.col("contract_type_id").alias("id"),
            F.col("contract_name").alias("name"), F.lit(None).cast("string").alias("category"), "description",
            F.coalesce("used", F.lit(0)).alias("used"),
        )
        .unionByName(
            t.service_types.join(services, "service_type_id", "left").select(
                F.lit("service").alias("lookup"), F.col("service_type_id").alias("id"),
                F.col("service_name").alias("name"), F.col("service_category").alias("category"), "description",
                F.coalesce("used", F.lit(0)).alias("used"),
            )
        )
    )


def _load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tables")
    sinks.load_tables(retention_tables(spark, sf_dir), path)
    return portable(quality.table_counts(sinks.stored_tables(spark, path)))


def _with_reasons(t: Tables) -> DataFrame:
    model = fixed_model()
    return explain.top_reasons(scoring.scored_customers(t, model), model)


def _predictions(t: Tables) -> DataFrame:
    return scoring.to_predictions(_with_reasons(t), "fixed-1", AS_OF, F.col("top_reasons"))


def _read_raw_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract with broken lines among its own: accepted and rejected lines by reason. Lines
    of ids on 0 lack their last field, those on 1 have one more, those on 2 a tenure in words."""
    path, last = new_path(spark, "raw-lines"), F.col("customerID").substr(-1, 1)
    shaped = raw_extract(spark, sf_dir)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shaped.columns]
    broken = [F.when((last == "2") & F.lit(c == "tenure"), F.lit("several")).otherwise(f) for c, f in zip(shaped.columns, fields)]
    line = F.when(last == "0", F.concat_ws(",", *broken[:-1])).when(last == "1", F.concat_ws(",", *broken, F.lit("x")))
    header = ",".join(shaped.columns)
    shaped.select(line.otherwise(F.concat_ws(",", *broken)).alias(header)).write.option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(path)
    accepted, rejected = raw.read_raw_checked(spark, path)
    counted = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))
    whole = accepted.agg(F.lit("accepted").alias("reason"), F.count(F.lit(1)).alias("n"), F.min("customerID").alias("first_line"))
    return portable(counted.select("reason", "n", F.split("first_line", ",")[0].alias("first_id")).unionByName(
        whole.select("reason", "n", F.col("first_line").alias("first_id"))
    ))


def _search_indexed(t: Tables) -> DataFrame:
    spark, path = t.customers.sparkSession, new_path(t.customers.sparkSession, "search-index")
    indexes.write_search_index(t.customers, path)
    return views.hit_profile(t, indexes.search(spark, path, t, "R#00000_1", 20))


def _page_indexed(t: Tables) -> DataFrame:
    spark, path = t.customers.sparkSession, new_path(t.customers.sparkSession, "page-index")
    indexes.write_page_index(t.customers, path, 16)
    return views.page_profile(t, indexes.page(spark, path, 20, 40))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads and one that fails before it is switched to: the second is what readers see."""
    path, tables = new_path(spark, "snapshots"), retention_tables(spark, sf_dir)
    history.load_snapshot(replace(tables, customers=tables.customers.limit(5)), path)
    history.load_snapshot(tables, path)

    class Lost(Exception):
        pass

    def lose() -> None:
        raise Lost

    try:
        history.load_snapshot(replace(tables, customers=tables.customers.filter("churn")), path, before_switch=lose)
    except Lost:
        pass
    return portable(quality.table_counts(history.snapshot_tables(spark, path)))


def _latest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everybody scored by one version, those above 0.5 by a second one twice (a repeated batch):
    every customer's newest prediction and how many there are."""
    path = new_path(spark, "prediction-history")
    made = _predictions(retention_tables(spark, sf_dir)).select("customer_id", "churn_probability", "risk_level")
    history.append_predictions(made, path, "0001", "fixed-1", "2024-01-01")
    again = made.filter("churn_probability > 0.5").withColumn("churn_probability", F.col("churn_probability") / 2)
    for _ in range(2):
        history.append_predictions(again, path, "0002", "fixed-2", "2024-01-02")
    newest = history.latest_predictions(spark, path).select("customer_id", "churn_probability", "risk_level", "model_version", "scored_at")
    counts = history.prediction_history(spark, path).groupBy("customer_id").agg(F.count(F.lit(1)).alias("predictions"))
    return portable(newest.join(counts, "customer_id"))


def _write_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "features")
    frame = feat.training_frame(views.feature_base(retention_tables(spark, sf_dir)))
    sinks.write_features(frame, path, "csv")
    shape = T.StructType(
        [T.StructField(c, frame.schema[c].dataType) for c in FEATURES]
        + [T.StructField("churn", T.IntegerType()), T.StructField("customer_id", T.StringType())]
    )
    return portable(spark.read.schema(shape).option("header", True).csv(path))


def _write_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "predictions")
    sinks.write_predictions(_predictions(retention_tables(spark, sf_dir)), path)
    return portable(
        spark.read.parquet(path).select(
            "customer_id", "churn_probability", "churn_prediction", "risk_level", "model_version",
            F.date_format("prediction_date", "yyyy-MM-dd").alias("prediction_day"),
            F.size("top_factors").alias("factors"),
            F.col("top_factors")[0]["feature"].alias("first_factor"),
        )
    )


def _check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tables = new_path(spark, "predictions"), retention_tables(spark, sf_dir)
    scored = scoring.scored_customers(tables, fixed_model())
    narrow = scoring.to_predictions(scored, "fixed-1", AS_OF).select("customer_id", "churn_probability", "risk_level")
    narrow.write.parquet(path)
    stored = spark.read.schema(narrow.schema).parquet(path)
    return portable(quality.check_rules(tables, stored))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, model = new_path(spark, "artifacts"), fixed_model()
    scored = scoring.scored_customers(retention_tables(spark, sf_dir), model)
    ranked = explain.importance(scored, model).withColumn("importance", F.round("importance", 6))
    sinks.write_artifacts(path, spark, model.name, AS_OF, model.features, {}, 0, 0, ranked, model)
    return portable(sinks.stored_importance(spark, path, top=None))


def _export_risk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "risk-list")
    listed = reports.risk_list(scoring.scored_customers(retention_tables(spark, sf_dir), fixed_model()))
    sinks.export_risk_list(listed, path)
    return portable(spark.read.schema(listed.schema).option("header", True).csv(path))


def _query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(
        sinks.query_table(
            spark,
            "SELECT customer_id, tenure_months, monthly_charges FROM {customers}"
            " WHERE tenure_months <= :tenure AND monthly_charges >= :charge AND gender = :gender",
            {"tenure": 12, "charge": 70, "gender": "Female"},
            customers=retention_tables(spark, sf_dir).customers,
        )
    )


# --- ranking ----------------------------------------------------------------------------------


def _ntiles(t: Tables) -> DataFrame:
    narrow = t.customers.select("customer_id", "monthly_charges", "tenure_months")
    wanted = {"charge_quarter": ("monthly_charges", 4), "tenure_fifth": ("tenure_months", 5)}
    cuts, _ = ranking.look_up(
        narrow, {n: F.col(c) for n, (c, _) in wanted.items()}, {n: ranking.ntile_places(k) for n, (_, k) in wanted.items()},
        tie="customer_id",
    )
    return narrow.select(
        "customer_id", *[ranking.tile_column(F.col(c), F.col("customer_id"), cuts[n]).alias(n) for n, (c, _) in wanted.items()]
    )


def _median(t: Tables) -> DataFrame:
    columns = {"median_monthly": "monthly_charges", "median_total": "total_charges"}
    found = ranking.exact_quantiles(t.customers, {n: (F.col(c), [0.5]) for n, c in columns.items()})
    return literal_rows(t.customers.sparkSession, [tuple(found[n][0] for n in columns)], list(columns))


def _per_tenure(t: Tables) -> DataFrame:
    """At most one row per month of tenure, so windows over it stay small."""
    return t.customers.groupBy("tenure_months").agg(
        F.count(F.lit(1)).alias("customers"), count_if(F.col("churn")).alias("churned")
    )


def _running_sum(t: Tables) -> DataFrame:
    so_far = W.orderBy("tenure_months").rangeBetween(W.unboundedPreceding, W.currentRow)
    return _per_tenure(t).select(
        "tenure_months", "customers",
        F.sum("customers").over(so_far).alias("customers_so_far"),
        F.sum("churned").over(so_far).alias("churned_so_far"),
    )


def _lag(t: Tables) -> DataFrame:
    return _per_tenure(t).select(
        "tenure_months", "customers",
        F.lag("customers").over(W.orderBy("tenure_months")).alias("previous_customers"),
    )


def _fixed_bins(t: Tables) -> DataFrame:
    bins = [(6, 1), (12, 2), (24, 3), (48, 4), (None, 5)]
    return t.customers.select("customer_id", bands.up_to(F.col("tenure_months"), bins).alias("tenure_bucket"))


def _charge_histogram(t: Tables) -> DataFrame:
    return reports.histogram(t.customers, F.col("monthly_charges").cast("double"), 25.0, 100.0, 20)


# --- features, splits, evaluation -------------------------------------------------------------


def _feature_group(names: list[str]) -> Query:
    return _on_tables(
        lambda t: feat.with_features(views.feature_base(t), "fit", names=names).select("customer_id", *names)
    )


# Feature groups of the record alone: equal in every mode, without a fit; and the tables they need.
_OWN_GROUPS = {
    "f01_demographics": {"contract": False, "services": False},
    "f02_services": {"contract": False, "services": True},
    "f03_contract": {"contract": True, "services": False},
}


def _own_feature_group(key: str, names: list[str]) -> Query:
    return _on_tables(
        lambda t: feat.with_features(views.feature_base(t, **_OWN_GROUPS[key]), "serve", names=names).select(
            "customer_id", *names
        )
    )


def _serve_features(requests: DataFrame) -> DataFrame:
    return feat.select_features(feat.with_features(quality.valid_requests(requests), "serve"))[0]


def _training_frame(t: Tables) -> DataFrame:
    return feat.training_frame(views.feature_base(t))


def _labelled(t: Tables) -> DataFrame:
    return t.customers.select("customer_id", F.col("churn").cast("int").alias("churn"))


def _split(t: Tables) -> DataFrame:
    return splits.stratified_split(_labelled(t))


def _standardise(t: Tables) -> DataFrame:
    frame = splits.stratified_split(_training_frame(t), labels=_labelled(t)).persist()
    scaler = splits.Scaler.fit(frame.filter("part = 'train'"), FEATURES)
    scaled = scaler.transform(frame.drop("churn", "part"))
    return scaled.select("customer_id", *[F.round(c, 6).alias(c) for c in FEATURES])


def _class_weights(t: Tables) -> DataFrame:
    return splits.class_weights(_split(t).filter("part = 'train'"))


def _judged(t: Tables) -> DataFrame:
    names = ["risk_score", "high_risk_flag"]
    built = feat.with_features(views.feature_base(t), "fit", keep=("churn",), names=names)
    return built.select(
        "customer_id", F.col("churn").cast("int").alias("churn"), "risk_score",
        F.col("high_risk_flag").alias("churn_prediction"),
    )


def _metrics(t: Tables) -> DataFrame:
    return evaluate.metrics(_judged(t), score="risk_score")


def _rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _targets(t: Tables) -> DataFrame:
    return _rounded(evaluate.check_targets(_metrics(t)), "actual")


def _compare_models(t: Tables) -> DataFrame:
    scorers = {
        "RiskScore": ("risk_score", F.col("high_risk_flag")),
        "RiskFactors": ("risk_factors_count", (F.col("risk_factors_count") >= 3).cast("int")),
        "MonthlyCharges": ("monthly_charges", F.col("is_high_value")),
    }
    names = ["risk_score", "risk_factors_count", "monthly_charges", "high_risk_flag", "is_high_value"]
    built = feat.with_features(views.feature_base(t), "fit", keep=("churn",), names=names)
    stacked = built.select(F.col("churn").cast("int").alias("churn"), F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("model"), F.coalesce(F.col(score), F.lit(0)).cast("double").alias("score"),
            F.coalesce(prediction, F.lit(0)).alias("churn_prediction"),
        )
        for name, (score, prediction) in scorers.items()
    ])))
    order = F.array_position(F.array(*map(F.lit, scorers)), F.col("model")).cast("int")
    measured = evaluate.model_metrics(stacked, score="score").withColumn("model_order", order)
    compared = evaluate.compare_models(measured)
    return _rounded(compared, *[c for c in compared.columns if c not in ("model", "is_best")])


# --- training ---------------------------------------------------------------------------------


def _resampled(t: Tables) -> DataFrame:
    """Class sizes after oversampling the scaled train rows."""
    train = splits.stratified_split(_training_frame(t), labels=_labelled(t)).filter("part = 'train'").drop("part").persist()
    scaled = splits.Scaler.fit(train, FEATURES).transform(train)
    return resampling.smote(scaled, FEATURES).groupBy("churn", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def _trained(name: str) -> Query:
    """Test metrics of one learner, fitted on the balanced train part."""

    def measure(t: Tables) -> DataFrame:
        trained = training.train_models(views.feature_base(t), {name: training.LEARNERS[name]})
        trained.prepared.release()
        return trained.long(t.customers.sparkSession).select("model", "metric", "value")

    return _on_tables(measure)


def _cross_validated(t: Tables) -> DataFrame:
    return validation.cross_validate(views.feature_base(t))


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "runs")
    base = views.feature_base(retention_tables(spark, sf_dir))
    trained = training.train_models(base)
    training.log_runs(trained, path, spark, "run-1", AS_OF)
    trained.prepared.release()
    return portable(spark.read.parquet(path))


def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold after a run over all learners, as rows of 1."""
    out = new_path(spark, "job")
    metrics = job.run(retention_tables(spark, sf_dir), out, AS_OF)
    auc = "CAST(value AS DOUBLE)"
    tests = spark.read.parquet(f"{out}/runs").filter("name = 'test_roc_auc'")
    best = metrics.filter("metric = 'roc_auc'").select(F.col("model_name").alias("model"), F.col("value").alias("reported"))
    checks = tests.agg(F.count("*").alias("n"), F.max(F.expr(auc)).alias("top"), F.min(F.expr(auc)).alias("low"))
    won = tests.join(best, "model").agg(F.max(F.abs(F.expr(auc) - F.col("reported"))).alias("off"), F.max(F.expr(auc)).alias("won"))
    again = spark.read.parquet(f"{out}/reload_check")
    facts = (checks.first().asDict() | won.first().asDict() | again.first().asDict())  # one row each
    sizes = sinks.model_info(spark, f"{out}/model").first()
    given = spark.read.schema("customer_id string").option("header", True).csv(f"{out}/features").count()
    held = {
        "three_models_logged": facts["n"] == 3,
        "metrics_in_range": 0 <= facts["low"] <= facts["top"] <= 1,
        "best_has_largest_auc": facts["won"] == facts["top"] and facts["off"] == 0,
        "reloaded_scores_all_test_rows": facts["rows"] == sizes["n_test_samples"],
        "reloaded_equals_model": facts["gap"] < 1e-9,
        "parts_add_up": sizes["n_training_samples"] + sizes["n_test_samples"] == given,
    }
    return literal_rows(spark, [(name, int(ok)) for name, ok in held.items()], ["check", "holds"]).select(
        "check", F.col("holds").cast("long").alias("holds")
    )


def _tree_reasons(t: Tables) -> DataFrame:
    """Every test record's reasons from a forest, with whether all its attributions add up."""
    prepared, forest = _grown(views.feature_base(t), "RandomForest")
    explained = path_attribution.attributions(prepared.test, forest, FEATURES, averaged=True)
    base = path_attribution.expected(path_attribution.path_leaves(forest, 1 / len(forest.feature)))
    summed = explained.groupBy("customer_id").agg(F.sum("phi").alias("total"))
    scored = histogram_trees.predict(prepared.test.withColumn("model", F.lit(0)), FEATURES, {0: forest}, validation.LEARNERS["RandomForest"])
    exact = summed.join(scored, "customer_id").select(
        "customer_id", (F.abs(F.col("total") - F.col("probability") + base) < 1e-9).alias("adds_up")
    )
    return serving.ranked_reasons(explained).join(exact, "customer_id")


def _grown(base: DataFrame, learner: str) -> tuple[training.Prepared, histogram_trees.Trees]:
    """One of the histogram learners, fitted on the balanced train part."""
    prepared = training.prepare_split(base)
    rows = histogram_trees.Training(prepared.train.withColumn("model", F.lit(0)), FEATURES)
    trees = rows.grow(validation.LEARNERS[learner])[0]
    rows.release()
    return prepared, trees


def _histogram_learner(learner: str) -> Query:
    """Its test metrics."""

    def measure(t: Tables) -> DataFrame:
        prepared, trees = _grown(views.feature_base(t), learner)
        scored = histogram_trees.predict(prepared.test.withColumn("model", F.lit(0)), FEATURES, {0: trees}, validation.LEARNERS[learner])
        return evaluate.metrics(scored).select(F.lit(learner).alias("model"), "metric", "value")

    return _on_tables(measure)


def _tree_attribution(t: Tables) -> DataFrame:
    """Every test row's path-dependent attributions by a forest, summed up per feature."""
    prepared, forest = _grown(views.feature_base(t), "RandomForest")
    return trees.tree_importance(path_attribution.attributions(prepared.test, forest, FEATURES, averaged=True))


# --- scoring and attribution ------------------------------------------------------------------


def _attributions(df: DataFrame) -> DataFrame:
    return explain.attributions(df, fixed_model()).withColumn("phi", F.round("phi", 4))


def _centred(df: DataFrame) -> DataFrame:
    model = fixed_model()
    long = explain.attributions(df, model, explain.scaled_means(df, model))
    return long.select("customer_id", "position", "feature", F.round("phi", 8).alias("phi"))


def _reasons(t: Tables) -> DataFrame:
    return _rounded(explain.reason_rows(_with_reasons(t)), "impact", "shap_value", digits=4)


def _at_risk_scored(t: Tables) -> DataFrame:
    rows = scoring.at_risk_scored(t, fixed_model(), 50, 0.8)
    return rows.select(
        *[c for c in rows.columns if c != "top_reasons"], F.posexplode("top_reasons").alias("p", "r")
    ).select("*", (F.col("p") + 1).alias("reason_rank"), "r.feature", "r.direction").drop("p", "r")


def _reason_text(df: DataFrame) -> DataFrame:
    long = explain.attributions(df, fixed_model()).select(
        "feature", F.when(F.col("phi") > 0, "increases").otherwise("decreases").alias("direction")
    )
    return (
        long.groupBy("feature", "direction")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "feature", "direction",
            explain.reason_text(F.col("feature"), F.col("direction")).alias("online_text"),
            explain.reason_text(F.col("feature"), F.col("direction"), explain.BATCH_NAMES).alias("batch_text"),
            "n",
        )
    )


def _importance(df: DataFrame) -> DataFrame:
    return explain.importance(df, fixed_model(), top=20).withColumn("importance", F.round("importance", 6))


def _score_customer(t: Tables) -> DataFrame:
    model = fixed_model()
    scored = scoring.score_customer(t, model, CUSTOMER).withColumn("churn_probability", F.round("probability", 4))
    with_reasons = explain.top_reasons(scored, model)
    return with_reasons.select(
        "customer_id", "churn_probability", "risk_level", F.posexplode("top_reasons").alias("p", "r")
    ).select(
        "customer_id", "churn_probability", "risk_level", (F.col("p") + 1).alias("reason_rank"),
        "r.feature", F.round("r.impact", 4).alias("impact"),
    )


def _model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, model = new_path(spark, "model"), fixed_model()
    t = retention_tables(spark, sf_dir)
    measured = {r["metric"]: r["value"] for r in _metrics(t).collect()}  # six rows
    parts = {r["part"]: r["n"] for r in _split(t).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    sinks.write_artifacts(
        path, spark, model.name, AS_OF, model.features, measured, parts["train"], parts["test"], linear=model
    )
    return portable(_rounded(sinks.model_info(spark, path).drop("training_date"), "value"))


# --- what-if and streams ----------------------------------------------------------------------


def _advice_rows(df: DataFrame, column: str) -> DataFrame:
    return df.select("customer_id", F.explode(column).alias("advice"))


def _what_if_inputs(requests: DataFrame) -> DataFrame:
    return reports.what_if_inputs(requests).select("customer_id", "multiple_lines", *feat.ADD_ONS)


def _categories(df: DataFrame) -> DataFrame:
    found = reports.feature_categories(explain.importance(df, fixed_model()))
    return found.withColumn("importance", F.round("importance", 6))


def _customer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given customer table, a file or a folder of files, read as a stream of scoring requests.

    A path that names a file must be a pattern for the stream reader, hence the bracket. A file
    written as one row group is read by one task, so its rows are dealt to all cores.
    """
    given = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    arriving = spark.readStream.schema(given).parquet(f"{sf_dir}/customer.parque[t]")
    return online.raw_to_requests(raw_shape(arriving.repartition(spark.sparkContext.defaultParallelism)))


def _stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mark = new_path(spark, "responses"), new_path(spark, "responses-progress")
    online.start_scoring(_customer_stream(spark, sf_dir), fixed_model(), out, mark, once=True).awaitTermination()
    answers = spark.read.parquet(out).select(
        "customer_id", "churn_prediction", "churn_probability", "risk_level", F.posexplode("top_reasons").alias("p", "r")
    )
    return portable(
        answers.select(
            "customer_id", "churn_prediction", "churn_probability", "risk_level", (F.col("p") + 1).alias("reason_rank"),
            "r.feature", "r.direction", F.round("r.impact", 4).alias("impact"), "r.description",
        )
    )


def _stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mark = new_path(spark, "summary"), new_path(spark, "summary-progress")
    online.start_summary(_customer_stream(spark, sf_dir), fixed_model(), out, mark, once=True).awaitTermination()
    return portable(online.latest_summary(spark, out))


def all_queries() -> dict[str, Query]:
    model = fixed_model()
    found: dict[str, Query] = {
        "s01_read_raw": _read_raw,
        "s01b_rejected_lines": _read_raw_checked,
        "s02_normalise_columns": _on_raw(raw.normalise_columns),
        "s03_coerce_charges": _on_raw(
            lambda df: raw.coerce_charges(_lower_cleaned(df)).select("customerid", "monthlycharges", "totalcharges")
        ),
        "s04_yes_no_to_bool": _on_raw(
            lambda df: raw.yes_no_to_bool(_lower_cleaned(df)).select("customerid", *raw.YES_NO_COLUMNS)
        ),
        "s05_int_to_bool": _on_raw(
            lambda df: raw.int_to_bool(_lower_cleaned(df)).select("customerid", "seniorcitizen")
        ),
        "s06_to_customers": _on_raw(lambda df: raw.to_customers(raw.clean(df))),
        "s07_assign_churn_date": _on_raw(
            lambda df: raw.assign_churn_date(raw.to_customers(raw.clean(df)), AS_OF).select(
                "customer_id", "churn", "churn_date"
            )
        ),
        "s08_to_contracts": _on_raw(lambda df: raw.ingest(df, AS_OF).customer_contracts),
        "s09_to_services": _on_raw(lambda df: raw.ingest(df, AS_OF).customer_services),
        "s10_lookup_use": _on_tables(_lookup_use),
        "s11_load_tables": _load_tables,
        "s11b_load_as_one": _snapshot,
        "s12_table_counts": _on_tables(quality.table_counts),
        "s13_check_rules": _check_rules,
        "s13b_rejected_requests": _on_requests(
            lambda df: quality.rejected_requests(df).select("customer_id", F.explode("broken_rules").alias("rule"))
        ),
        "s13c_batch_size": _on_requests(quality.check_batch_size),
        "s14_write_features": _write_features,
        "s15_write_predictions": _write_predictions,
        "s16_artifacts": _artifacts,
        "s17_export_risk_list": _export_risk_list,
        "s18_query_table": _query_table,
        "v1_customer_full": _on_tables(views.customer_full),
        "v2_services_summary": _on_tables(views.services_summary),
        "v3_churn_summary": _on_tables(views.churn_summary),
        "v4_feature_base": _on_tables(views.feature_base),
        "v5_get_customers": _on_tables(lambda t: views.get_customers(t, 100, churn_only=True)),
        "s15b_latest_predictions": _latest_predictions,
        "l2b_page_by_index": _on_tables(_page_indexed),
        "l4b_search_by_index": _on_tables(_search_indexed),
        "l1_customer_by_id": _on_tables(lambda t: views.customer_by_id(t, CUSTOMER)),
        "l2_list_customers": _on_tables(lambda t: views.list_customers(t, 20, 40)),
        "l3_at_risk_profile": _on_tables(lambda t: views.at_risk_profile(t, 50)),
        "l4_search_customers": _on_tables(lambda t: views.search_customers(t, "R#00000_1", 20)),
        "l5_at_risk_scored": _on_tables(_at_risk_scored),
        "q01_overall_summary": _on_tables(analytics.overall_summary),
        "q02_churn_by_contract": _on_tables(analytics.churn_by_contract),
        "q03_churn_by_tenure": _on_tables(analytics.churn_by_tenure),
        "q04_churn_by_payment": _on_tables(analytics.churn_by_payment),
        "q05_revenue_impact": _on_tables(analytics.revenue_impact),
        "q06_service_adoption": _on_tables(analytics.service_adoption),
        "q07_risk_segments": _on_tables(analytics.risk_segments),
        "q08_demographics": _on_tables(analytics.demographics),
        "q09_clv_quartiles": _on_tables(analytics.clv_quartiles),
        "q09b_clv_ranks": _on_tables(analytics.clv_ranks),
        "q10_rfm_segments": _on_tables(analytics.rfm_segments),
        "q11_charge_bands": _on_tables(analytics.charge_bands),
        "q12_bundle_sizes": _on_tables(analytics.bundle_sizes),
        "q12b_service_bundles": _on_tables(analytics.service_bundles),
        "q13_tenure_cohorts": _on_tables(analytics.tenure_cohorts),
        "q14_contract_opportunities": _on_tables(analytics.contract_opportunities),
        "q15_executive_kpis": _on_tables(analytics.executive_kpis),
        "q16_loyal_low_spenders": _on_tables(analytics.loyal_low_spenders),
        "w1_global_ntile": _on_tables(_ntiles),
        "w2_global_rank": _on_tables(
            lambda t: ranking.add_rank(
                t.customers.select("customer_id", "monthly_charges"), -F.col("monthly_charges"), "charge_rank"
            ).drop("monthly_charges")
        ),
        "w3_first_rank_quartile": _on_tables(
            lambda t: ranking.add_first_rank_quartile(
                t.customers, "tenure_months", "customer_id", "tenure_quartile"
            ).select("customer_id", "tenure_quartile")
        ),
        "w4_value_quartile": _on_tables(
            lambda t: ranking.add_value_quartile(t.customers, "monthly_charges", "charge_quartile").select(
                "customer_id", "charge_quartile"
            )
        ),
        "w5_median": _on_tables(_median),
        "w6_running_sum": _on_tables(_running_sum),
        "w7_lag": _on_tables(_lag),
        "w8_fixed_bins": _on_tables(_fixed_bins),
        "w9_histogram": _on_tables(_charge_histogram),
        **{
            key: _own_feature_group(key, names) if key in _OWN_GROUPS else _feature_group(names)
            for key, names in GROUPS.items()
        },
        "f08_select_features": _on_tables(_training_frame),
        "f09_serve_features": _on_requests(_serve_features),
        "f10_profile_to_request": _on_requests(lambda df: df),
        "f11_class_balance": _on_tables(lambda t: feat.class_balance(_labelled(t))),
        "m01_split": _on_tables(_split),
        "m02_standardise": _on_tables(_standardise),
        "m03_smote": _on_tables(_resampled),
        "m04_class_weights": _on_tables(_class_weights),
        "m05_logistic_regression": _trained("LogisticRegression"),
        "m06_random_forest": _trained("RandomForest"),
        "m07_boosted_trees": _trained("GradientBoosting"),
        "m06b_histogram_forest": _histogram_learner("RandomForest"),
        "m07b_second_order_boosting": _histogram_learner("GradientBoosting"),
        "m08_cross_validation": _on_tables(_cross_validated),
        "m09_metrics": _on_tables(lambda t: _rounded(_metrics(t), "value")),
        "m10_roc_points": _on_tables(lambda t: evaluate.roc_points(_judged(t), score="risk_score")),
        "m11_confusion_matrix": _on_tables(lambda t: evaluate.confusion_matrix(_judged(t))),
        "m12_compare_models": _on_tables(_compare_models),
        "m13_check_targets": _on_tables(_targets),
        "m14_run_log": _run_log,
        "m15_training_job": _job,
        "p01_score": _on_scored(lambda df: df.select("customer_id", "churn_probability", "churn_prediction")),
        "p02_risk_levels": _on_scored(
            lambda df: df.select(
                "customer_id", "risk_level", bands.table_risk_level(F.col("probability")).alias("stored_risk_level")
            )
        ),
        "p03_linear_attribution": _on_scored(_attributions),
        "p03b_centred_attribution": _on_scored(_centred),
        "p04_tree_attribution": _on_tables(_tree_attribution),
        "p04b_tree_reasons": _on_tables(_tree_reasons),
        "p05_top_reasons": _on_tables(_reasons),
        "p06_reason_text": _on_scored(_reason_text),
        "p07_top_reason": _on_scored(
            lambda df: explain.top_reason(df, fixed_model()).select("customer_id", "top_reason")
        ),
        "p08_batch_summary": _on_scored(scoring.batch_summary),
        "p09_importance": _on_scored(_importance),
        "p10_score_customer": _on_tables(_score_customer),
        "p11_model_info": _model_info,
        "d01_risk_kpis": _on_scored(reports.risk_kpis),
        "d02_risk_distribution": _on_scored(reports.risk_distribution),
        "d03_probability_histogram": _on_scored(reports.probability_histogram),
        "d04_risk_by_contract": _on_scored(lambda df: reports.risk_by(df, "contract_type")),
        "d05_risk_by_payment": _on_scored(lambda df: reports.risk_by(df, "payment_method")),
        "d06_top_at_risk": _on_scored(reports.top_at_risk),
        "d07_risk_list": _on_scored(lambda df: reports.risk_list(df, 0.6, ["critical", "High"], "R#0000", 75)),
        "d08_risk_list_stats": _on_scored(
            lambda df: reports.risk_list_stats(reports.risk_list(df, 0.6, ["critical", "High"], "R#0000", 75))
        ),
        "d09_retention_advice": _on_requests(
            lambda df: _advice_rows(reports.retention_advice(df), "recommendations")
        ),
        "d10_what_if_inputs": _on_requests(_what_if_inputs),
        "d11_what_if_advice": _on_requests(lambda df: _advice_rows(reports.what_if_advice(df), "suggestions")),
        "d12_scenarios": _on_requests(lambda df: reports.scenarios(df, fixed_model())),
        "d12b_best_scenario": _on_requests(
            lambda df: reports.best_scenario(reports.scenarios(df, fixed_model()))
        ),
        "d13_feature_categories": _on_scored(_categories),
        "d14_metrics_vs_targets": _on_tables(_targets),
        "x1_stream_scoring": _stream_scoring,
        "x2_stream_summary": _stream_summary,
    }
    return found
