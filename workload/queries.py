"""The registered queries: every operator over the billing tables of `fixtures`."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwright import schemas
from costwright.functions import formats
from costwright.functions.dates import days_ago, last_days
from costwright.functions.money import rounded
from costwright.operators import (
    anomaly,
    chargeback,
    cost,
    forecast,
    optimize,
    policy,
    reports,
    responses,
    run_metrics,
)
from costwright.plans import gold, silver
from costwright.sources import bronze, ingest, tables
from workload import fixtures, layers
from workload.fixtures import AS_OF, DAYS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MONTH = 30
# thresholds at which each run finding has rows in the test data
ZSCORE, WOW_PCT, SHARE_PCT = 2.0, 10.0, 10.0
RUN_ID = "run-1"
RUN_START = datetime(2001, 7, 20, 6, 0, 0)
RUN_END = datetime(2001, 7, 20, 6, 1, 30)
ALL_TIME = None  # no window: every record, also those after the as-of date


REPORT_FINDING = (
    "severity", "headline", "finding_type", "daily_cost_usd", "total_cost_usd",
    "pct_above_baseline", "dim_value",
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def flat(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: DECIMAL as DOUBLE, times as text, no structs."""
    columns = []
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            columns.append(F.col(name).cast("double").alias(name))
        elif kind.startswith("timestamp"):
            columns.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        elif kind == "boolean" or kind.startswith("struct"):
            columns.append(F.col(name).cast("string").alias(name))
        elif kind.startswith("array"):
            columns.append(F.array_join(name, ",").alias(name))
        elif kind != "map<string,string>":
            columns.append(F.col(name))
    return df.select(*columns)


# ---------------------------------------------------------------- layers


def usage(spark, sf_dir, days=DAYS):
    return bronze.billing_usage(fixtures.usage_source(spark, sf_dir), AS_OF, days)


def prices(spark, sf_dir):
    return bronze.list_prices(fixtures.price_source(spark, sf_dir))


def price_list(spark, sf_dir):
    """The prices, to be broadcast: some for each part type, however many parts there are. Spark takes the
    list to grow with the part table and would shuffle all records by their few SKUs."""
    return F.broadcast(prices(spark, sf_dir))


def clusters(spark, sf_dir):
    return bronze.clusters(fixtures.cluster_source(spark, sf_dir))


def enriched(spark, sf_dir, days=DAYS):
    return silver.usage_enriched(usage(spark, sf_dir, days), price_list(spark, sf_dir), AS_OF)


def daily(spark, sf_dir, days=DAYS):
    return gold.daily_cost(enriched(spark, sf_dir, days))


# ------------------------------------------------- sources and tables


@query
def bronze_billing_usage(spark, sf_dir):
    df = usage(spark, sf_dir)
    return flat(df.select(
        "*",
        F.col("custom_tags")["Environment"].alias("environment"),
        F.col("custom_tags")["Project"].alias("project"),
        F.col("custom_tags")["Owner"].alias("owner"),
        F.col("custom_tags")["Team"].alias("team"),
        F.col("custom_tags")["CostCenter"].alias("cost_center"),
        "usage_metadata.*", "identity_metadata.*",
    ).drop("custom_tags", "usage_metadata", "identity_metadata"))


@query
def bronze_list_prices(spark, sf_dir):
    df = prices(spark, sf_dir)
    return flat(df.select("*", F.col("pricing")["default"].alias("price")).drop("pricing"))


@query
def bronze_clusters(spark, sf_dir):
    df = clusters(spark, sf_dir)
    return flat(df.withColumn("tags", F.col("tags")["Owner"]))


@query
def bronze_job_runs(spark, sf_dir):
    return flat(bronze.job_runs(fixtures.job_run_source(spark, sf_dir), AS_OF, DAYS))


@query
def merge_upsert(spark, sf_dir):
    """The daily rollup as first loaded, brought up to date for the last month.

    The first load had only records below 25 units; the others came late.
    """
    keys = ["usage_date", "workspace_id", "sku_name", "billing_origin_product"]
    records = enriched(spark, sf_dir, ALL_TIME)
    first_load = gold.daily_cost(records.where("usage_quantity < 25"))
    update = gold.daily_cost(records.where(last_days(AS_OF, MONTH)))
    return flat(tables.merge_upsert(
        first_load, update, keys, ["total_cost_usd", "record_count"]
    ))


COUNTED = (
    "bronze.billing_usage", "bronze.list_prices", "bronze.clusters", "silver.usage_enriched",
    *(f"gold.{name}" for name in ingest.ROLLUPS),
)


@query
def ingest_row_counts(spark, sf_dir):
    """Rows per table of the written layers."""
    written = layers.stored(spark, sf_dir)
    return bronze.row_counts({n: spark.table(f"{written.prefix}{n}") for n in COUNTED})


@query
def refresh_layers(spark, sf_dir):
    """A full refresh of all layers, as read back: rows, dates and partitions of each table."""
    written = layers.refreshed(spark, sf_dir)

    def profile(name):
        df = spark.table(f"{written.prefix}{name}")
        date = F.col("usage_date") if "usage_date" in df.columns else F.lit(None).cast("date")
        cost = next((c for c in df.columns if c in ("estimated_cost_usd", "total_cost_usd")), None)
        return df.groupBy().agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            F.min(date).alias("first_date"),
            F.max(date).alias("last_date"),
            F.count_distinct(date).alias("dates"),
            rounded(F.sum(cost) if cost else F.lit(None), 4).alias("cost_usd"),
        )

    found = None
    for name in (*COUNTED, "bronze.job_runs"):
        found = profile(name) if found is None else found.unionByName(profile(name))
    return found


@query
def stored_rollups(spark, sf_dir):
    """Totals per date of each written rollup in the last month; only its folders are read."""
    written, found = layers.stored(spark, sf_dir), None
    for name in ingest.ROLLUPS:
        totals = written.rollup(name, AS_OF, MONTH).groupBy("usage_date").agg(
            F.lit(name).alias("rollup"), F.count("*").alias("rows"),
            F.sum("total_usage").alias("total_usage"), F.sum("total_cost_usd").alias("total_cost_usd"),
        )
        found = totals if found is None else found.unionByName(totals)
    return flat(found)


@query
def late_records(spark, sf_dir):
    """Rollups kept up to date: records of 25 units and more of the last week came late.

    The layers are first written without them, then brought up to date twice.
    """
    source = fixtures.usage_source(spark, sf_dir)
    late = last_days(AS_OF, 7) & (F.col("usage_quantity") >= 25)
    prefix = f"costwright_{uuid.uuid4().hex[:12]}_"
    ingest.refresh(
        spark, source.where(~late), fixtures.price_source(spark, sf_dir),
        fixtures.cluster_source(spark, sf_dir), fixtures.job_run_source(spark, sf_dir),
        AS_OF, MONTH, prefix,
    )
    written = ingest.Layers(spark, prefix)
    for _ in range(2):
        ingest.apply_late(written, bronze.billing_usage(source.where(late), AS_OF, 7), AS_OF)
    found = None
    for name in ingest.ROLLUPS:
        rows = written.rollup(name, AS_OF, MONTH)
        keys = [c for c, kind in rows.dtypes if kind == "string"]
        one = rows.select(
            "usage_date", F.lit(name).alias("rollup"), F.concat_ws("|", *keys).alias("keys"),
            "total_usage", "total_cost_usd",
        )
        found = one if found is None else found.unionByName(one)
    return flat(found)


@query
def merge_into_table(spark, sf_dir):
    """The upsert of `merge_upsert` into a written table, a row per date of the result.

    `rewritten` tells whether any file of the date is new: only dates of the last month are.
    """
    keys = ["usage_date", "workspace_id", "sku_name", "billing_origin_product"]
    records = layers.stored(spark, sf_dir).usage_enriched(AS_OF, DAYS)
    schema = f"costwright_{uuid.uuid4().hex[:12]}"
    name, before = f"{schema}.daily_cost", f"{schema}.files_before"
    spark.sql(f"CREATE SCHEMA {schema}")
    first_load = gold.daily_cost(records.where("usage_quantity < 25"))
    tables.write_table(ingest.by_date(first_load), name, partition_by=["usage_date"])
    file = F.col("_metadata.file_path").alias("file")
    tables.write_table(spark.table(name).select(file).distinct(), before)

    update = gold.daily_cost(records.where(last_days(AS_OF, MONTH)))
    tables.merge_into_table(update, name, keys, ["total_cost_usd", "record_count"])
    by_file = spark.table(name).groupBy("usage_date", file).agg(
        F.count("*").alias("rows"), F.sum("total_usage").alias("total_usage"),
        F.sum("total_cost_usd").alias("total_cost_usd"), F.sum("record_count").alias("record_count"),
    )
    old = spark.table(before).select("file", F.lit(True).alias("old"))
    return flat(by_file.join(old, "file", "left").groupBy("usage_date").agg(
        F.sum("rows").alias("rows"), F.sum("total_usage").alias("total_usage"),
        F.sum("total_cost_usd").alias("total_cost_usd"), F.sum("record_count").alias("record_count"),
        F.bool_or(F.col("old").isNull()).alias("rewritten"),
    ))


@query
def stored_runs(spark, sf_dir):
    """Findings and recommendations of two runs, one of them stored twice, as read back."""
    database = f"costwright_{uuid.uuid4().hex[:12]}"
    tables.create_audit_tables(spark, database)
    _, findings = _run(spark, sf_dir)
    found = _recommendations(spark, sf_dir)
    for run in (RUN_ID, "run-2", RUN_ID):
        tables.replace_run(tables.findings_rows(findings, run), database, "findings", run)
        rows = tables.recommendations_rows(found, run, RUN_END)
        tables.replace_run(rows, database, "recommendations", run)
    stored = spark.table(f"{database}.findings").select(
        F.lit("findings").alias("audit_table"), "run_id", F.col("finding_id").alias("id"),
        F.col("finding_type").alias("type"), "status", F.col("detected_date").alias("day"),
    )
    return stored.unionByName(spark.table(f"{database}.recommendations").select(
        F.lit("recommendations").alias("audit_table"), "run_id",
        F.col("recommendation_id").alias("id"), F.col("recommendation_type").alias("type"),
        "status", F.col("created_date").alias("day"),
    ))


@query
def audit_defaults(spark, sf_dir):
    """Rows with only some columns, inserted into each audit table and read back whole.

    Calls come from the event log, runs from their calls, findings and actions from the
    findings of each user.
    """
    database = f"costwright_{uuid.uuid4().hex[:12]}"
    tables.create_audit_tables(spark, database)
    calls = fixtures.call_source(spark, sf_dir)
    runs = calls.groupBy("run_id").agg(F.min("called_at").alias("started_at"))
    found = fixtures.finding_source(spark, sf_dir).select(
        "finding_id", F.lit(RUN_ID).alias("run_id"), F.lit(RUN_END).alias("detected_at"),
        F.lit("anomaly").alias("finding_type"), F.lit("LOW").alias("severity"),
    )
    wanted = found.select(
        F.concat(F.lit("do-"), "finding_id").alias("recommendation_id"), "run_id",
        F.lit(RUN_END).alias("created_at"), F.lit("RIGHT_SIZE").alias("recommendation_type"),
        F.lit("resize").alias("title"),
    )
    actions = found.select(
        F.concat(F.lit("act-"), "finding_id").alias("action_id"), "run_id", "finding_id",
        F.lit(RUN_END).alias("proposed_at"), F.lit("notify").alias("action_type"),
    )
    partial = {
        "llm_calls": calls.select("call_id", "run_id", "called_at", "endpoint"), "runs": runs,
        "findings": found, "recommendations": wanted, "actions": actions,
    }
    stored = None
    for name, rows in partial.items():
        tables.insert_partial(rows, database, name)
        kept = spark.table(f"{database}.{name}").select(*schemas.AUDIT[name].names)
        texts = [
            F.concat(
                F.lit(f"{c}="),
                F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind == "timestamp"
                else F.col(c).cast("string"),
            )
            for c, kind in kept.dtypes
        ]
        row = F.concat_ws("|", *texts)
        one = kept.select(F.lit(name).alias("audit_table"), row.alias("stored"))
        stored = one if stored is None else stored.unionByName(one)
    return stored


# ---------------------------------------------------------------- silver


PRICED = [
    "record_id", "sku_name", "cloud", "usage_date", "usage_quantity", "price_per_unit",
    "currency_code",
]


def _priced(spark, sf_dir, price_list):
    priced = silver.price_interval_join(usage(spark, sf_dir, ALL_TIME), price_list, AS_OF)
    return flat(priced.select(*PRICED))


@query
def price_interval_join(spark, sf_dir):
    return _priced(spark, sf_dir, price_list(spark, sf_dir))


@query
def price_interval_join_shuffled(spark, sf_dir):
    """The same join where Spark may not broadcast the list, as with one too large for that."""
    return _priced(spark, sf_dir, prices(spark, sf_dir).hint("merge"))


@query
def price_interval_join_sliced(spark, sf_dir):
    """The same join by slices of time, as for a list with very many intervals."""
    records = usage(spark, sf_dir, ALL_TIME)
    first, last = fixtures.usage_span(spark, sf_dir)
    priced = silver.price_interval_join_sliced(
        records, prices(spark, sf_dir), AS_OF, first, last
    )
    return flat(priced.select(*PRICED))


@query
def price_history_join(spark, sf_dir):
    """Every order date changes all prices: thousands of intervals a SKU, sliced by time."""
    records = usage(spark, sf_dir, ALL_TIME)
    first, last = fixtures.usage_span(spark, sf_dir)
    history = bronze.list_prices(fixtures.price_history_source(spark, sf_dir))
    priced = silver.price_interval_join_sliced(records, history, AS_OF, first, last)
    return flat(priced.select(*PRICED))


@query
def usage_without_prices(spark, sf_dir):
    """A price list that is not there: every record stays and costs nothing."""
    missing = bronze.load_or_empty(spark, f"{sf_dir}/no_such_prices.parquet", schemas.LIST_PRICES)
    records = silver.usage_enriched(usage(spark, sf_dir, ALL_TIME), missing, AS_OF)
    return flat(records.select("record_id", "usage_quantity", "estimated_cost_usd"))


@query
def cost_computation(spark, sf_dir):
    priced = silver.price_interval_join(
        usage(spark, sf_dir, ALL_TIME), price_list(spark, sf_dir), AS_OF
    )
    return flat(silver.with_cost(priced).select(
        "record_id", "usage_quantity", "price_per_unit", "estimated_cost_usd"
    ))


@query
def tag_extraction(spark, sf_dir):
    return silver.with_tags(usage(spark, sf_dir, ALL_TIME)).select(
        "record_id", *silver.TAG_COLUMNS.values()
    )


SILVER_COLUMNS = [
    "record_id", "workspace_id", "sku_name", "cloud", "usage_date", "usage_month",
    "usage_unit", "usage_quantity", "estimated_cost_usd", "tag_environment",
    "tag_project", "tag_owner", "tag_team", "tag_costcenter", "custom_tags",
    "cluster_id", "warehouse_id", "job_id", "notebook_id", "pipeline_id",
    "run_as_user", "owned_by", "billing_origin_product", "usage_type", "record_type",
]


@query
def usage_enriched(spark, sf_dir):
    return flat(enriched(spark, sf_dir, ALL_TIME).select(*SILVER_COLUMNS))


# ---------------------------------------------------------------- gold


@query
def gold_daily_cost(spark, sf_dir):
    return flat(daily(spark, sf_dir, ALL_TIME))


@query
def gold_cost_by_user(spark, sf_dir):
    return flat(gold.cost_by_user(enriched(spark, sf_dir, ALL_TIME)))


@query
def gold_cost_by_tags(spark, sf_dir):
    return flat(gold.cost_by_tags(enriched(spark, sf_dir, ALL_TIME)))


@query
def gold_cost_by_resource(spark, sf_dir):
    return flat(gold.cost_by_resource(enriched(spark, sf_dir, ALL_TIME)))


@query
def daily_totals_latest(spark, sf_dir):
    return gold.latest_daily_totals(daily(spark, sf_dir, ALL_TIME))


# ---------------------------------------------------------- cost analysis


@query
def total_cost(spark, sf_dir):
    return cost.total_cost(daily(spark, sf_dir), AS_OF, days=7)


@query
def total_cost_one_workspace(spark, sf_dir):
    return cost.total_cost(daily(spark, sf_dir), AS_OF, days=MONTH, workspace_id="ws-2")


@query
def total_cost_by_workspace(spark, sf_dir):
    return cost.total_cost_by_workspace(daily(spark, sf_dir), AS_OF, days=MONTH)


def _breakdown(dimension):
    def run(spark, sf_dir):
        return cost.cost_breakdown(enriched(spark, sf_dir), dimension, AS_OF, days=MONTH)

    run.__name__ = f"cost_breakdown_{dimension}"
    return query(run)


for _dimension in ("sku", "product", "user", "team", "project", "environment", "workspace"):
    _breakdown(_dimension)


@query
def top_spenders_user(spark, sf_dir):
    by_user = gold.cost_by_user(enriched(spark, sf_dir))
    return cost.top_spenders(by_user, "user", AS_OF, days=MONTH)


@query
def top_spenders_resource(spark, sf_dir):
    by_resource = gold.cost_by_resource(enriched(spark, sf_dir))
    return cost.top_spenders(by_resource, "resource", AS_OF, days=MONTH)


def _trend(granularity):
    def run(spark, sf_dir):
        return cost.cost_trend(daily(spark, sf_dir), AS_OF, DAYS, granularity)

    run.__name__ = f"cost_trend_{granularity}"
    return query(run)


for _granularity in ("day", "week", "month"):
    _trend(_granularity)


# --------------------------------------------------------------- anomalies


def _spikes(spark, sf_dir, dimension, ordered=True):
    # Single resources cost little here, so their floor is lower.
    floor = 1.0 if dimension == "resource" else 5.0
    return anomaly.cost_spikes(
        enriched(spark, sf_dir), AS_OF, DAYS, min_daily_usd=floor, dimension=dimension,
        ordered=ordered,
    )


@query
def cost_spikes_workspace(spark, sf_dir):
    return _spikes(spark, sf_dir, "workspace")


@query
def cost_spikes_sku(spark, sf_dir):
    return _spikes(spark, sf_dir, "sku")


@query
def cost_spikes_resource(spark, sf_dir):
    return _spikes(spark, sf_dir, "resource")


@query
def sustained_spikes(spark, sf_dir):
    return anomaly.sustained_spikes(_spikes(spark, sf_dir, "workspace", ordered=False))


@query
def idle_clusters(spark, sf_dir):
    return anomaly.idle_clusters(
        enriched(spark, sf_dir), clusters(spark, sf_dir), AS_OF, DAYS
    )


@query
def idle_clusters_no_metadata(spark, sf_dir):
    return anomaly.idle_clusters_no_metadata(enriched(spark, sf_dir), AS_OF, MONTH)


@query
def idle_warehouses(spark, sf_dir):
    return anomaly.idle_warehouses(enriched(spark, sf_dir), AS_OF, MONTH)


def _zscores(spark, sf_dir):
    return run_metrics.daily_zscore_anomalies(daily(spark, sf_dir), AS_OF, DAYS, zscore=ZSCORE)


def _metrics(spark, sf_dir):
    return run_metrics.run_metrics(daily(spark, sf_dir), AS_OF, DAYS)


def _comparable(findings):
    """Findings with the numbers of the evidence rounded, not as JSON text."""
    numbers = [
        rounded(F.get_json_object("evidence", f"$.{n}").cast("double"), 4).alias(n)
        for n in ("zscore", "mean", "std", "share_pct", "wow_change_pct")
    ]
    return flat(findings.select(
        "finding_id", "category", "severity", "title", "description", "affected_resource",
        rounded("metric_value", 4).alias("metric_value"),
        rounded("baseline_value", 4).alias("baseline_value"),
        "detected_at", *numbers,
    ))


@query
def daily_zscore_anomalies(spark, sf_dir):
    return _comparable(_zscores(spark, sf_dir))


@query
def sku_concentration(spark, sf_dir):
    return _comparable(
        run_metrics.sku_concentration(_metrics(spark, sf_dir), AS_OF, SHARE_PCT)
    )


@query
def wow_jump(spark, sf_dir):
    return _comparable(run_metrics.wow_jump(_metrics(spark, sf_dir), AS_OF, WOW_PCT))


# ------------------------------------------------------------- run metrics


@query
def top_skus(spark, sf_dir):
    return run_metrics.top_skus(daily(spark, sf_dir), AS_OF, DAYS)


@query
def summary_metrics(spark, sf_dir):
    return run_metrics.summary_metrics(daily(spark, sf_dir), AS_OF, DAYS)


def _run(spark, sf_dir):
    """The run's metrics and findings, both from the written daily rollup."""
    rollup = layers.stored(spark, sf_dir).rollup("daily_cost", AS_OF, DAYS)
    metrics = run_metrics.run_metrics(rollup, AS_OF, DAYS)
    findings = run_metrics.all_findings(
        run_metrics.daily_zscore_anomalies(rollup, AS_OF, DAYS, zscore=ZSCORE),
        run_metrics.metric_findings(metrics, AS_OF, SHARE_PCT, WOW_PCT),
    )
    return metrics.drop("top_sku", "top_sku_cost_usd"), findings


@query
def all_findings(spark, sf_dir):
    return _comparable(_run(spark, sf_dir)[1])


@query
def persist_findings(spark, sf_dir):
    rows = tables.findings_rows(_run(spark, sf_dir)[1], RUN_ID)
    return flat(rows.select(
        "finding_id", "run_id", "detected_at", "finding_type", "severity", "resource_id",
        rounded("metric_value", 4).alias("metric_value"),
        rounded("baseline_value", 4).alias("baseline_value"),
        rounded("delta_pct", 4).alias("delta_pct"),
        "headline", "explanation",
        rounded(F.get_json_object("raw_data", "$.zscore").cast("double"), 4).alias("zscore"),
        "status",
    ))


# ---------------------------------------------------------- recommendations


@query
def rec_rightsizing(spark, sf_dir):
    return optimize.recommend_rightsizing(
        enriched(spark, sf_dir), clusters(spark, sf_dir), AS_OF, MONTH
    )


@query
def rec_rightsizing_no_metadata(spark, sf_dir):
    return optimize.recommend_rightsizing(enriched(spark, sf_dir), None, AS_OF, MONTH)


@query
def rec_autoscale(spark, sf_dir):
    return optimize.recommend_autoscale(
        enriched(spark, sf_dir), clusters(spark, sf_dir), AS_OF, DAYS
    )


@query
def rec_photon(spark, sf_dir):
    return optimize.recommend_photon(enriched(spark, sf_dir), AS_OF, MONTH)


@query
def rec_serverless(spark, sf_dir):
    return optimize.recommend_serverless(enriched(spark, sf_dir), AS_OF, DAYS)


def _recommendations(spark, sf_dir):
    written = layers.stored(spark, sf_dir)
    records, meta = written.usage_enriched(AS_OF, DAYS), written.clusters()
    return optimize.all_recommendations({
        optimize.RIGHT_SIZE: optimize.recommend_rightsizing(
            records, meta, AS_OF, MONTH, ordered=False),
        optimize.ENABLE_AUTOSCALE: optimize.recommend_autoscale(
            records, meta, AS_OF, DAYS, ordered=False),
        optimize.ENABLE_PHOTON: optimize.recommend_photon(
            records, AS_OF, MONTH, ordered=False),
        optimize.MIGRATE_SERVERLESS: optimize.recommend_serverless(
            records, AS_OF, DAYS, ordered=False),
    })


@query
def all_recommendations(spark, sf_dir):
    return _recommendations(spark, sf_dir)


@query
def persist_recommendations(spark, sf_dir):
    rows = tables.recommendations_rows(
        chargeback.prioritize(_recommendations(spark, sf_dir), ordered=False), RUN_ID, RUN_END
    )
    return flat(rows)


@query
def persist_parsed_recommendations(spark, sf_dir):
    """Rows for recommendations that came as JSON, with the ids of their findings."""
    parsed = responses.parse_recommendations(
        fixtures.response_source(spark, sf_dir), fixtures.finding_source(spark, sf_dir), AS_OF
    )
    rows = tables.recommendations_rows(parsed, RUN_ID, RUN_END)
    return flat(rows)


@query
def prioritize_recommendations(spark, sf_dir):
    return chargeback.prioritize(_recommendations(spark, sf_dir)).select(
        "recommendation_id", "expected_savings_usd_monthly", "priority_score", "priority_tier"
    )


@query
def persist_run(spark, sf_dir):
    metrics, findings = _run(spark, sf_dir)
    recommendations = responses.parse_recommendations(
        fixtures.response_source(spark, sf_dir), fixtures.finding_source(spark, sf_dir), AS_OF
    )
    row = tables.run_row(
        findings, recommendations, metrics, RUN_ID, RUN_START, RUN_END,
        config={"lookback_days": DAYS, "top_n_skus": 10}, timings={"analyze": 1.5},
        errors=["load: none"],
        calls=responses.usage_rollup(fixtures.call_source(spark, sf_dir)),
        report=reports.report_text(_cost_summary(spark, sf_dir)),
    )
    total = F.get_json_object("config_snapshot", "$.summary_metrics.total_cost_usd")
    days = F.get_json_object("config_snapshot", "$.config.lookback_days")
    timing = F.get_json_object("config_snapshot", "$.node_timings_ms.analyze")
    return flat(row.select(
        "*", total.cast("double").alias("total_cost_usd"),
        days.cast("int").alias("config_days"), timing.cast("double").alias("analyze_ms"),
        F.get_json_object("config_snapshot", "$.report_markdown").alias("report_markdown"),
    ).drop("config_snapshot"))


# ------------------------------------------------------ forecast and policy


@query
def month_end_projection(spark, sf_dir):
    return forecast.month_end_projection(daily(spark, sf_dir), AS_OF)


@query
def month_end_projection_by_workspace(spark, sf_dir):
    return forecast.month_end_projection_by_workspace(daily(spark, sf_dir), AS_OF)


@query
def burn_rate(spark, sf_dir):
    return forecast.burn_rate(daily(spark, sf_dir), fixtures.budgets(spark, sf_dir), AS_OF)


@query
def untagged_resources(spark, sf_dir):
    return flat(policy.untagged_resources(enriched(spark, sf_dir), AS_OF, MONTH))


@query
def expensive_node_types(spark, sf_dir):
    return policy.expensive_node_types(
        enriched(spark, sf_dir), clusters(spark, sf_dir), AS_OF, MONTH
    )


@query
def tag_compliance(spark, sf_dir):
    return policy.tag_compliance(enriched(spark, sf_dir), AS_OF, MONTH)


# ----------------------------------------------------------------- reports


def _cost_summary(spark, sf_dir):
    written = layers.stored(spark, sf_dir)
    records = written.usage_enriched(AS_OF, DAYS)
    rollup = written.rollup("daily_cost", AS_OF, DAYS)
    return reports.cost_summary_report(
        cost.total_cost(rollup, AS_OF, MONTH),
        cost.cost_breakdown(records, "product", AS_OF, MONTH, top_n=None),
        cost.top_spenders(
            written.rollup("cost_by_user", AS_OF, DAYS), "user", AS_OF, days=MONTH
        ),
        cost.cost_trend(rollup, AS_OF, DAYS, "week"),
    )


def _findings(spark, sf_dir):
    """The report on spikes, idle clusters and untagged resources."""
    written = layers.stored(spark, sf_dir)
    records = written.usage_enriched(AS_OF, DAYS)
    found = run_metrics.all_findings(
        anomaly.cost_spikes(records, AS_OF, DAYS, ordered=False),
        anomaly.idle_clusters(records, written.clusters(), AS_OF, DAYS, ordered=False),
        policy.untagged_resources(records, AS_OF, MONTH, ordered=False),
    )
    return reports.findings_report(found.select(*REPORT_FINDING))


def _recommendation_lines(spark, sf_dir):
    return reports.recommendations_report(_recommendations(spark, sf_dir))


@query
def cost_summary_report(spark, sf_dir):
    return _cost_summary(spark, sf_dir)


@query
def findings_report(spark, sf_dir):
    return _findings(spark, sf_dir)


@query
def recommendations_report(spark, sf_dir):
    return _recommendation_lines(spark, sf_dir)


@query
def report_text(spark, sf_dir):
    lines = (
        _cost_summary(spark, sf_dir)
        .unionByName(_findings(spark, sf_dir))
        .unionByName(_recommendation_lines(spark, sf_dir))
    )
    return reports.report_text(lines)


# ------------------------------------------------- model answers and chargeback


@query
def parse_llm_recommendations(spark, sf_dir):
    return flat(responses.parse_recommendations(
        fixtures.response_source(spark, sf_dir), fixtures.finding_source(spark, sf_dir), AS_OF
    ))


@query
def extract_json_object(spark, sf_dir):
    found = responses.extract_json_object(fixtures.response_source(spark, sf_dir))
    return flat(found.drop("response_text"))


@query
def llm_usage_rollup(spark, sf_dir):
    return responses.usage_rollup(fixtures.call_source(spark, sf_dir))


@query
def team_chargeback(spark, sf_dir):
    months = chargeback.team_chargeback(enriched(spark, sf_dir, ALL_TIME))
    text = F.transform(
        "top_drivers",
        lambda d: F.concat_ws(":", d["resource_type"], d["resource_id"],
                              d["cost_usd"].cast("decimal(18,2)").cast("string"),
                              d["untagged_usd"].cast("decimal(18,2)").cast("string")),
    )
    return months.withColumn("top_drivers", F.array_join(text, "; "))


@query
def format_functions(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders")
    amount = F.col("o_totalprice")
    signed = F.when(F.col("o_orderkey") % 3 != 0, amount - 250000)
    power = F.expr("CAST(1 << (4 * CAST(o_orderkey % 14 AS INT)) AS DOUBLE)")
    size = F.col("o_orderkey").cast("double") + 1
    size = size * F.when(F.col("o_orderkey") % 14 < 8, power).otherwise(F.lit(1048576.0) * 1048576)
    return orders.select(
        "o_orderkey",
        formats.fmt_usd(signed).alias("usd"),
        formats.fmt_usd(amount, 0).alias("usd_whole"),
        formats.fmt_pct(signed / 1000000).alias("pct"),
        formats.fmt_pct_change(
            F.when(F.col("o_orderkey") % 5 != 0, amount), F.lit(200000.0)
        ).alias("pct_change"),
        formats.fmt_dbu(signed / 100).alias("dbu"),
        formats.fmt_bytes(size).alias("bytes"),
        formats.fmt_duration(F.col("o_orderkey") * 37).alias("duration"),
        formats.truncate(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus"), 9)
        .alias("short"),
        days_ago(AS_OF, 5).alias("day"),
    )
