"""Billing tables derived from the test tables.

Each is a plain projection of joins over the given parquet tables, so a query's
work grows with them. No join here has a broadcast hint: the given tables grow with the
scale, and Spark chooses by size.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from costwright.schemas import PRICE, QUANTITY

AS_OF = date(2001, 7, 20)
DAYS = 90

RECORD = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
CLOUDS = ("AWS", "AZURE", "GCP")
PRODUCTS = ("SQL", "JOBS", "ALL_PURPOSE", "DLT")
SKU_SUFFIX = {"A": "_PHOTON", "R": "_SERVERLESS", "N": ""}
BASE_PRICE = {
    "STANDARD": "0.10", "SMALL": "0.15", "LARGE": "0.40",
    "PROMO": "0.22", "ECONOMY": "0.07", "MEDIUM": "0.30",
}
PRICE_CHANGE = ("1990-01-01", "1998-07-01")
# monthly dollars per customer of workspace 0 to 4, and of the whole account
BUDGET_PER_CUSTOMER = ("1.00", "2.00", "3.00", "4.00", "0.00")
ACCOUNT_BUDGET_PER_CUSTOMER = "3.00"


# The schema of each path read so far: inferring one takes a Spark job.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _lookup(key: Column, values) -> Column:
    """The value at a position, or under a name."""
    if isinstance(values, dict):
        pairs = values.items()
    else:
        pairs = enumerate(values)
    result = None
    for k, v in pairs:
        result = F.when(key == k, v) if result is None else result.when(key == k, v)
    return result


def _id(prefix: str, key: Column, width: int | None = None) -> Column:
    text = key.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, width, "0") if width else text)


def _case(key: str, values: dict) -> str:
    """SQL for the value under a key."""
    cases = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items())
    return f"CASE {key} {cases} END"


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


# The usage columns as expressions over line item, part, supplier, order and customer.
USAGE_TAGS = {
    "Environment": _when("o_orderpriority <> '4-NOT SPECIFIED'", "substring(o_orderpriority, 3)"),
    "Project": _when("p_size % 4 <> 0", "p_brand"),
    "Owner": _when("c_custkey % 3 <> 0", "c_name"),
    "Team": _when("c_custkey % 5 <> 0", "c_mktsegment"),
    "CostCenter": _when("c_custkey % 7 <> 0", "concat('cc-', c_nationkey)"),
}
USAGE_RESOURCE = {
    "cluster_id": _when("l_suppkey % 4 = 0", "concat('cluster-', lpad(l_suppkey, 8, '0'))"),
    "warehouse_id": _when("l_suppkey % 4 = 1", "concat('warehouse-', lpad(l_suppkey, 8, '0'))"),
    "job_id": _when("l_suppkey % 4 = 2", "concat('job-', l_suppkey)"),
    "notebook_id": "CAST(NULL AS STRING)",
    "dlt_pipeline_id": _when(
        "l_suppkey % 4 = 3 AND l_linenumber % 2 <> 0", "concat('pipeline-', l_suppkey)"
    ),
}
USAGE_IDENTITY = {
    "run_as": _when("o_orderstatus <> 'F'", "c_name"),
    "owned_by": _when("l_linenumber % 3 <> 0", "s_name"),
}


def _struct(fields: dict) -> str:
    return f"struct({', '.join(f'{value} AS {name}' for name, value in fields.items())})"


USAGE = {
    "record_id": f"concat_ws('-', {', '.join(RECORD)})",
    "account_id": "'account-1'",
    "workspace_id": "concat('ws-', c_nationkey % 5)",
    "sku_name": f"concat(p_type, {_case('l_returnflag', SKU_SUFFIX)})",
    "cloud": _case("s_nationkey % 3", dict(enumerate(CLOUDS))),
    "usage_start_time": "CAST(l_shipdate AS TIMESTAMP)",
    "usage_end_time": "CAST(l_shipdate + INTERVAL 1 HOUR AS TIMESTAMP)",
    "usage_date": "to_date(l_shipdate)",
    "custom_tags": f"map({', '.join(f'{k!r}, {v}' for k, v in USAGE_TAGS.items())})",
    "usage_unit": "'DBU'",
    "usage_quantity": f"CAST(l_quantity AS {QUANTITY.simpleString()})",
    "usage_metadata": _struct(USAGE_RESOURCE),
    "identity_metadata": _struct(USAGE_IDENTITY),
    "record_type": "'ORIGINAL'",
    "ingestion_date": "to_date(l_shipdate)",
    "billing_origin_product": _case("l_linenumber % 4", dict(enumerate(PRODUCTS))),
    "product_features": "CAST(NULL AS STRING)",
    "usage_type": "'COMPUTE_TIME'",
}


def usage_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw usage records: one per line item.

    Orders meet their customers first, so that line items are not shuffled for them.
    """

    def t(name):
        return table(spark, sf_dir, name)

    orders = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(t("part"), F.expr("l_partkey = p_partkey"))
        .join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(*[f"{value} AS {name}" for name, value in USAGE.items()])
    )


def price_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of every part type's SKUs, per cloud, before and after a price change."""
    base = f"CAST({_case('p_type', BASE_PRICE)} AS DECIMAL(6,2))"
    first, second = (f"TIMESTAMP '{day} 00:00:00'" for day in PRICE_CHANGE)
    suffixes = ", ".join(repr(s) for s in SKU_SUFFIX.values())
    clouds = ", ".join(repr(c) for c in CLOUDS)
    return (
        table(spark, sf_dir, "part").select("p_type").distinct()
        .selectExpr("p_type", f"{base} AS base", f"explode(array({suffixes})) AS suffix")
        .selectExpr("*", f"explode(array({clouds})) AS cloud")
        .where("NOT (p_type = 'ECONOMY' AND cloud = 'GCP')")
        .selectExpr(
            "*",
            "explode(array("
            f"struct({first} AS start, {second} AS end, CAST(1.00 AS DECIMAL(4,2)) AS factor), "
            f"struct({second} AS start, CAST(NULL AS TIMESTAMP) AS end, "
            "CAST(1.25 AS DECIMAL(4,2)) AS factor))) AS interval",
        )
        .selectExpr(
            "interval.start AS price_start_time",
            "interval.end AS price_end_time",
            "'account-1' AS account_id",
            "concat(p_type, suffix) AS sku_name",
            "cloud",
            "'USD' AS currency_code",
            "'DBU' AS usage_unit",
            f"struct(CAST(base * interval.factor AS {PRICE.simpleString()}) AS `default`) "
            "AS pricing",
        )
    )


def usage_span(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """The first and last date of all usage records."""
    day = F.to_date("l_shipdate")
    return tuple(table(spark, sf_dir, "lineitem").agg(F.min(day), F.max(day)).first())


def price_history_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that change on every date on which their SKU was used; the last one stays open."""
    used = usage_source(spark, sf_dir).select("sku_name", "cloud", "usage_date").distinct()
    until = F.lead("usage_date").over(Window.partitionBy("sku_name", "cloud").orderBy("usage_date"))
    changes = used.withColumn("until", until)
    current = price_source(spark, sf_dir).where("price_end_time IS NULL")
    kind = PRICE.simpleString()
    step = "CAST(dayofyear(usage_date) % 50 AS DECIMAL(4,0)) * CAST(0.0001 AS DECIMAL(5,4))"
    return current.join(changes, ["sku_name", "cloud"]).selectExpr(
        "CAST(usage_date AS TIMESTAMP) AS price_start_time",
        "CAST(until AS TIMESTAMP) AS price_end_time",
        "account_id", "sku_name", "cloud", "currency_code", "usage_unit",
        f"struct(CAST(pricing.`default` + {step} AS {kind}) AS `default`) AS pricing",
    )


def cluster_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configuration versions of most clusters; the rest have no metadata."""
    key = F.col("s_suppkey")
    k = F.floor(key / 4)
    small = F.lit("Standard_DS3_v2")
    older = F.struct(F.lit("1999-01-01").alias("day"), F.lit(30).alias("minutes"),
                     F.lit("JOB").alias("source"))
    newer = F.struct(
        F.lit("2001-01-01").alias("day"),
        _lookup(k % 5, {1: 0, 2: 60, 3: 180, 4: 240}).alias("minutes"),
        _lookup(k % 4, {0: "UI", 1: "API", 3: "JOB"}).alias("source"),
    )
    autoscales = k % 3 == 0
    workers = (k % 8 + 1).cast("int")
    nothing = F.lit(None).cast("string")
    day = F.col("version.day").cast("date")
    return (
        table(spark, sf_dir, "supplier")
        .where((key % 4 == 0) & (k % 7 != 6))
        .withColumn("version", F.explode(F.array(older, newer)))
        .select(
            F.lit("account-1").alias("account_id"),
            _id("ws-", F.col("s_nationkey") % 5).alias("workspace_id"),
            _id("cluster-", key, 8).alias("cluster_id"),
            F.when(k % 6 != 5, _id("compute ", key)).alias("cluster_name"),
            F.col("s_name").alias("owned_by"),
            F.lit("1998-01-01").cast("timestamp").alias("create_time"),
            F.lit(None).cast("timestamp").alias("delete_time"),
            F.when(key % 3 == 0, "Standard_NC24s_v3").otherwise(small).alias("driver_node_type"),
            F.coalesce(_lookup(key % 5, {0: "Standard_E64s_v3", 1: "Standard_M128s"}), small)
            .alias("worker_node_type"),
            workers.alias("worker_count"),
            F.when(autoscales, 1).alias("min_autoscale_workers"),
            F.when(autoscales, workers + 4).alias("max_autoscale_workers"),
            F.col("version.minutes").alias("auto_termination_minutes"),
            F.lit(True).alias("enable_elastic_disk"),
            F.create_map(F.lit("Owner"), F.col("s_name")).alias("tags"),
            F.col("version.source").alias("cluster_source"),
            nothing.alias("init_scripts"),
            nothing.alias("aws_attributes"),
            nothing.alias("azure_attributes"),
            nothing.alias("gcp_attributes"),
            nothing.alias("driver_instance_pool_id"),
            nothing.alias("worker_instance_pool_id"),
            F.lit("16.4.x").alias("dbr_version"),
            day.cast("timestamp").alias("change_time"),
            day.alias("change_date"),
            F.lit("SINGLE_USER").alias("data_security_mode"),
            nothing.alias("policy_id"),
        )
    )


def job_run_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.lit("account-1").alias("account_id"),
        _id("ws-", F.col("o_custkey") % 5).alias("workspace_id"),
        _id("job-", F.col("o_custkey") % 100).alias("job_id"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        start.cast("timestamp").alias("period_start_time"),
        (start + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("period_end_time"),
        F.lit("SCHEDULE").alias("trigger_type"),
        F.lit("JOB_RUN").alias("run_type"),
        F.col("o_orderpriority").alias("run_name"),
        F.array(_id("cluster-", F.col("o_custkey") % 100, 8)).alias("compute_ids"),
        F.col("o_orderstatus").alias("result_state"),
        F.lit(None).cast("string").alias("termination_code"),
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly budget per workspace from its number of customers, and the account's."""
    n = F.col("c_nationkey") % 5
    customers = table(spark, sf_dir, "customer").groupBy(n.alias("n")).agg(
        F.count("*").alias("customers")
    )
    rate = _lookup(F.col("n"), BUDGET_PER_CUSTOMER).cast("decimal(8,2)")
    by_workspace = customers.select(
        _id("ws-", F.col("n")).alias("workspace_id"),
        (F.col("customers") * rate).cast("double").alias("monthly_budget_usd"),
    )
    account = customers.agg(
        F.lit(None).cast("string").alias("workspace_id"),
        (F.sum("customers") * F.lit(ACCOUNT_BUDGET_PER_CUSTOMER).cast("decimal(8,2)"))
        .cast("double").alias("monthly_budget_usd"),
    )
    return by_workspace.unionByName(account)


def call_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: one per event."""
    tokens = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("call_id"),
        _id("run-", F.col("user_id")).alias("run_id"),
        F.col("ts").cast("timestamp").alias("called_at"),
        F.col("event_type").alias("endpoint"),
        F.lit("anomaly_explanation").alias("purpose"),
        (tokens - F.floor(tokens / 3)).cast("int").alias("prompt_tokens"),
        F.floor(tokens / 3).cast("int").alias("completion_tokens"),
        tokens.alias("total_tokens"),
        F.col("value").alias("latency_seconds"),
        # every fifth call fails too, so that groups hold both outcomes
        (ok & (F.col("event_id") % 5 != 0)).alias("success"),
        F.when(~ok, "endpoint error").alias("error_message"),
    )


def finding_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that responses refer to: one per user seen, but not for every tenth."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.where(F.col("user_id") % 10 != 9).select(
        _id("finding-", F.col("user_id")).alias("finding_id"),
        _id("ws-", F.col("user_id") % 5).alias("affected_resource"),
    )


def response_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers, one per event, in the shapes that occur by `event_id % 6`.

    0 two items in a fence, 1 a bare list, 2 cut off, 3 null and missing fields,
    4 text after the list, 5 prose around an object.
    """
    shape = F.col("event_id") % 6
    finding = F.format_string('"finding_id": "finding-%d"', F.col("user_id"))
    amount = F.col("value").cast("decimal(12,2)").cast("string")
    full = F.concat(
        F.lit('{"action_type": "rightsize", "confidence": "high", "effort": "low", '),
        F.lit('"estimated_monthly_savings_usd": '), amount, F.lit(", "), finding,
        F.lit(', "rationale": "uses '), F.col("event_type"),
        F.lit('", "suggested_command": null, "title": "Resize '), F.col("event_type"),
        F.lit('"}'),
    )
    quoted = F.concat(
        F.lit('{"estimated_monthly_savings_usd": "'), amount,
        F.lit('", "title": "'), F.repeat(F.lit("long "), 60), F.lit('"}'),
    )
    sparse = F.concat(
        F.lit('{"action_type": null, "estimated_monthly_savings_usd": "soon", '),
        finding, F.lit("}"),
    )
    text = (
        F.when(shape == 0, F.concat(F.lit("```json\n["), full, F.lit(", "), quoted,
                                    F.lit("]\n```")))
        .when(shape == 1, F.concat(F.lit("  ["), full, F.lit("]\n")))
        .when(shape == 2, F.concat(F.lit("["), full, F.lit(', {"title": ')))
        .when(shape == 3, F.concat(F.lit("["), sparse, F.lit("]")))
        .when(shape == 4, F.concat(F.lit("["), full, F.lit("] as asked")))
        .otherwise(F.concat(F.lit("Here it is:\n"), full, F.lit("\nDone.")))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("response_id"), text.alias("response_text")
    )
