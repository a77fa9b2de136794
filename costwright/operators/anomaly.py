"""Findings on workspaces, SKUs and resources: spikes and idle spend."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costwright.functions.common import choose, in_order
from costwright.functions.dates import last_days
from costwright.functions.money import mean_of, rounded
from costwright.plans.gold import latest_clusters
from costwright.thresholds import DEFAULTS, Thresholds

# Texts and type names other readers of these findings match on.
COST_SPIKE = "COST_SPIKE"
IDLE_CLUSTER = "IDLE_CLUSTER_RISK"
IDLE_WAREHOUSE = "WAREHOUSE_UNDERUSED_RISK"
REASON_DISABLED = "Auto-termination disabled"
REASON_TOO_LONG = "Auto-termination too long (%d min)"
REASON_WAREHOUSE = "High cost — verify query volume justifies size & uptime"

BASELINE_ROWS = 7


def spike_severity(delta: Column, limits: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(delta >= limits.critical_delta_usd, "CRITICAL")
        .when(delta >= limits.high_delta_usd, "HIGH")
        .when(delta >= limits.medium_delta_usd, "MEDIUM")
        .otherwise("LOW")
    )


def cost_spikes(
    silver: DataFrame,
    as_of: date,
    lookback_days: int = 14,
    spike_pct: float = DEFAULTS.spike_pct,
    min_daily_usd: float = DEFAULTS.spike_min_daily_usd,
    dimension: str = "workspace",
    limits: Thresholds = DEFAULTS,
    ordered: bool = True,
) -> DataFrame:
    """Days on which a workspace, SKU or resource cost far more than before.

    The baseline is the mean of the seven rows before, which are observed days and
    not calendar days. Cost is summed per value and day first, so one window
    partition holds at most `lookback_days + 1` rows however hot its value is.
    """
    value = choose(
        {
            "workspace": F.col("workspace_id"),
            "sku": F.col("sku_name"),
            "resource": F.coalesce("cluster_id", "warehouse_id", "job_id", F.lit("unknown")),
        },
        dimension,
        "dimension",
    )
    daily = (
        silver.where(last_days(as_of, lookback_days))
        .groupBy("usage_date", value.alias("dim_value"))
        .agg(F.sum("estimated_cost_usd").alias("cost"))
    )
    before = (
        Window.partitionBy("dim_value").orderBy("usage_date").rowsBetween(-BASELINE_ROWS, -1)
    )
    compared = (
        daily.withColumn("baseline_days", F.count("cost").over(before))
        .withColumn("baseline", mean_of(F.sum("cost").over(before), F.col("baseline_days")))
        .withColumn("over", F.col("cost").cast("double") - F.col("baseline"))
        .withColumn("pct", F.col("over") / F.nullif("baseline", F.lit(0.0)) * 100)
    )
    spikes = compared.where(
        (F.col("cost") >= F.lit(min_daily_usd))
        & (F.col("baseline_days") >= limits.spike_min_baseline_days)
        & (F.col("baseline") > 0)
        & (F.col("pct") >= spike_pct)
    ).select(
        "usage_date",
        "dim_value",
        rounded("cost").alias("daily_cost_usd"),
        rounded("baseline").alias("baseline_avg_usd"),
        "baseline_days",
        rounded("pct", 1).alias("pct_above_baseline"),
        rounded("over").alias("delta_usd"),
        F.lit(dimension).alias("dimension"),
        F.lit(COST_SPIKE).alias("finding_type"),
    )
    spikes = spikes.withColumn("severity", spike_severity(F.col("delta_usd"), limits))
    return in_order(spikes, ordered, F.desc("usage_date"), F.desc("delta_usd"), "dim_value")


def sustained_spikes(
    spikes: DataFrame,
    min_days: int = DEFAULTS.sustained_days,
    limits: Thresholds = DEFAULTS,
) -> DataFrame:
    """Runs of at least `min_days` spike dates in a row.

    Consecutive dates less their row number share one date, which names the run.
    A run is at least MEDIUM; its dollars above baseline may lift it further.
    """
    by_date = Window.partitionBy("dimension", "dim_value").orderBy("usage_date")
    run = F.date_sub("usage_date", F.row_number().over(by_date))
    runs = (
        spikes.withColumn("run", run)
        .groupBy("dimension", "dim_value", "run")
        .agg(
            F.min("usage_date").alias("first_date"),
            F.max("usage_date").alias("last_date"),
            F.count("*").alias("spike_days"),
            rounded(F.sum(F.col("delta_usd").cast("decimal(28,8)"))).alias("total_delta_usd"),
            F.max("pct_above_baseline").alias("max_pct_above_baseline"),
        )
        .where(F.col("spike_days") >= min_days)
        .drop("run")
    )
    by_dollars = spike_severity(F.col("total_delta_usd"), limits)
    return runs.withColumn(
        "severity", F.when(by_dollars == "LOW", "MEDIUM").otherwise(by_dollars)
    ).withColumn("finding_type", F.lit("SUSTAINED_COST_SPIKE"))


def resource_costs(silver: DataFrame, column: str, as_of: date, days: int, *more) -> DataFrame:
    """Active days, exact cost and usage per resource and workspace."""
    return (
        silver.where(F.col(column).isNotNull() & last_days(as_of, days))
        .groupBy(column, "workspace_id", *more)
        .agg(
            F.count_distinct("usage_date").alias("active_days"),
            F.sum("estimated_cost_usd").alias("cost"),
            F.sum("usage_quantity").alias("dbu"),
        )
    )


def _idle_severity(limits: Thresholds) -> Column:
    return F.when(F.col("total_cost_usd") > limits.idle_high_usd, "HIGH").otherwise("MEDIUM")


def idle_clusters(
    silver: DataFrame,
    clusters: DataFrame,
    as_of: date,
    days: int = 7,
    limits: Thresholds = DEFAULTS,
    ordered: bool = True,
) -> DataFrame:
    """Costly interactive clusters that do not stop by themselves soon enough.

    A cluster without metadata passes: nothing shows that it would stop.
    """
    minutes = F.col("auto_termination_minutes")
    costs = resource_costs(silver, "cluster_id", as_of, days).where(
        F.col("cost") > F.lit(limits.idle_cluster_min_usd)
    )
    latest = latest_clusters(clusters).select(
        "cluster_id", "cluster_name", "owned_by", "worker_node_type", "driver_node_type",
        "worker_count", "auto_termination_minutes", "cluster_source",
    )
    idle = costs.join(latest, "cluster_id", "left").where(
        (minutes.isNull() | (minutes == 0) | (minutes > limits.max_auto_termination_minutes))
        & F.coalesce("cluster_source", F.lit("UI")).isin("UI", "API")
    )
    reason = F.when(minutes.isNull() | (minutes == 0), REASON_DISABLED).otherwise(
        F.format_string(REASON_TOO_LONG, minutes)
    )
    found = idle.select(
        "cluster_id", "cluster_name", "workspace_id", "owned_by",
        "worker_node_type", "driver_node_type", "worker_count",
        "auto_termination_minutes", "cluster_source", "active_days",
        rounded("cost").alias("total_cost_usd"),
        rounded("dbu").alias("total_dbu"),
        F.lit(IDLE_CLUSTER).alias("finding_type"),
        reason.alias("reason"),
    ).withColumn("severity", _idle_severity(limits))
    return in_order(found, ordered, F.desc("total_cost_usd"), "cluster_id", "workspace_id")


def idle_clusters_no_metadata(
    silver: DataFrame, as_of: date, days: int = 7, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """The same risk judged by cost alone, where no cluster table exists."""
    return (
        resource_costs(silver, "cluster_id", as_of, days)
        .select(
            "cluster_id",
            F.lit(None).cast("string").alias("cluster_name"),
            "workspace_id",
            F.lit(None).cast("string").alias("owned_by"),
            "active_days",
            rounded("cost").alias("total_cost_usd"),
            rounded("dbu").alias("total_dbu"),
            F.lit(IDLE_CLUSTER).alias("finding_type"),
            F.lit(REASON_DISABLED).alias("reason"),
        )
        .where(F.col("total_cost_usd") > limits.idle_resource_min_usd)
        .withColumn("severity", _idle_severity(limits))
        .orderBy(F.desc("total_cost_usd"), "cluster_id", "workspace_id")
    )


def idle_warehouses(
    silver: DataFrame, as_of: date, days: int = 7, limits: Thresholds = DEFAULTS
) -> DataFrame:
    return (
        resource_costs(silver, "warehouse_id", as_of, days)
        .select(
            "warehouse_id",
            "workspace_id",
            "active_days",
            rounded("cost").alias("total_cost_usd"),
            rounded("dbu").alias("total_dbu"),
            F.lit(IDLE_WAREHOUSE).alias("finding_type"),
            F.lit("MEDIUM").alias("severity"),
            F.lit(REASON_WAREHOUSE).alias("reason"),
        )
        .where(F.col("total_cost_usd") > limits.idle_resource_min_usd)
        .orderBy(F.desc("total_cost_usd"), "warehouse_id", "workspace_id")
    )
