"""Savings recommendations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.functions.common import in_order
from costwright.functions.dates import last_days
from costwright.functions.money import mean_of, rounded, shortest
from costwright.plans.gold import latest_clusters
from costwright.thresholds import DEFAULTS, Thresholds

# Recommendation types and the wording of titles and rationales.
RIGHT_SIZE = "RIGHT_SIZE"
ENABLE_AUTOSCALE = "ENABLE_AUTOSCALE"
ENABLE_PHOTON = "ENABLE_PHOTON"
MIGRATE_SERVERLESS = "MIGRATE_SERVERLESS"
RIGHT_SIZE_TITLE = "Right-size cluster %s"
RIGHT_SIZE_RATIONALE = (
    "Cluster cost $%s over %d days. "
    "Variance suggests over-provisioning during low-load periods."
)
AUTOSCALE_TITLE = "Enable autoscale on %s"
AUTOSCALE_RATIONALE = (
    "Fixed-size cluster (%d workers) shows high cost variance (CV=%s). "
    "Autoscale would reduce idle worker time."
)
PHOTON_TITLE = "Enable Photon on warehouse %s"
PHOTON_RATIONALE = (
    "Warehouse spent $%s on non-Photon SQL over %d days. "
    "Photon typically delivers 2-3x throughput, reducing $/query."
)
PHOTON_PRODUCTS = ("sql", "jobs", "all_purpose")
SERVERLESS_TITLE = "Migrate job %s to serverless"
SERVERLESS_RATIONALE = (
    "Short, recurring job (avg $%s/run). Serverless eliminates cluster startup overhead."
)

SHORT_ID = 12

COMMON = [
    "recommendation_type", "resource_type", "resource_id", "resource_name", "workspace_id",
    "title", "rationale", "expected_savings_usd_monthly", "confidence",
]


def short_name(name: str, id_column: str) -> Column:
    """The name, or the first characters of the id when there is none."""
    named = F.nullif(F.col(name), F.lit(""))
    return F.coalesce(named, F.substring(id_column, 1, SHORT_ID))


def monthly_savings(days: int, factor: float) -> Column:
    """The rounded cost of the window, scaled to thirty days, times the share saved."""
    per_day = F.coalesce("total_cost_usd", F.lit(0.0)) / F.lit(float(max(days, 1)))
    return rounded(per_day * 30.0 * factor)


def _recommend(df: DataFrame, kind: str, days: int, factor: float, confidence: str,
               title: Column, rationale: Column) -> DataFrame:
    return df.select(
        "*",
        F.lit(kind).alias("recommendation_type"),
        monthly_savings(days, factor).alias("expected_savings_usd_monthly"),
        F.lit(confidence).alias("confidence"),
        title.alias("title"),
        rationale.alias("rationale"),
    )


def _cluster_costs(silver: DataFrame, as_of: date, days: int) -> DataFrame:
    """Cost per cluster and workspace, with its spread over usage records."""
    cost = F.col("estimated_cost_usd")
    return (
        silver.where(F.col("cluster_id").isNotNull() & last_days(as_of, days))
        .groupBy("cluster_id", "workspace_id")
        .agg(
            F.count_distinct("usage_date").alias("active_days"),
            F.sum(cost).alias("cost"),
            F.sum("usage_quantity").alias("dbu"),
            mean_of(F.sum(cost), F.count(cost)).alias("mean_cost"),
            F.stddev_samp(cost.cast("double")).alias("spread"),
        )
    )


def _rightsize(
    costs: DataFrame, metadata: list, days: int, limits: Thresholds, ordered: bool
) -> DataFrame:
    per_day = mean_of(F.col("cost"), F.greatest(F.col("active_days"), F.lit(1)))
    candidates = costs.select(
        "cluster_id",
        "workspace_id",
        *metadata,
        "active_days",
        rounded("cost").alias("total_cost_usd"),
        rounded("dbu").alias("total_dbu"),
        rounded("mean_cost").alias("avg_daily_cost"),
        rounded(F.coalesce("spread", F.lit(0.0))).alias("stddev_daily_cost"),
        rounded(per_day).alias("cost_per_active_day"),
    )
    found = _recommend(
        candidates, RIGHT_SIZE, days, limits.rightsize_factor, "MEDIUM",
        F.format_string(RIGHT_SIZE_TITLE, short_name("cluster_name", "cluster_id")),
        F.format_string(RIGHT_SIZE_RATIONALE, shortest("total_cost_usd"), F.lit(days)),
    )
    return in_order(found, ordered, F.desc("total_cost_usd"), "cluster_id", "workspace_id")


RIGHTSIZE_METADATA = {
    "cluster_name": "string",
    "owned_by": "string",
    "worker_node_type": "string",
    "driver_node_type": "string",
    "worker_count": "int",
}


def recommend_rightsizing(
    silver: DataFrame,
    clusters: DataFrame | None,
    as_of: date,
    days: int = 14,
    min_cost_usd: float = DEFAULTS.rightsize_min_usd,
    limits: Thresholds = DEFAULTS,
    ordered: bool = True,
) -> DataFrame:
    """Costly clusters that look over-provisioned.

    Without a cluster table (`None`) the metadata columns are NULL.
    """
    costs = _cluster_costs(silver, as_of, days).where(F.col("cost") >= F.lit(min_cost_usd))
    if clusters is None:
        empty = [F.lit(None).cast(t).alias(n) for n, t in RIGHTSIZE_METADATA.items()]
        return _rightsize(costs, empty, days, limits, ordered)
    latest = latest_clusters(clusters).select("cluster_id", *RIGHTSIZE_METADATA)
    joined = costs.join(latest, "cluster_id", "left")
    return _rightsize(joined, list(RIGHTSIZE_METADATA), days, limits, ordered)


def recommend_autoscale(
    silver: DataFrame,
    clusters: DataFrame,
    as_of: date,
    days: int = 14,
    limits: Thresholds = DEFAULTS,
    ordered: bool = True,
) -> DataFrame:
    """Fixed-size clusters whose cost varies much from record to record."""
    costs = _cluster_costs(silver, as_of, days)
    varying = costs.withColumn("cv", F.col("spread") / F.nullif("mean_cost", F.lit(0.0))).where(
        (F.col("active_days") >= limits.autoscale_min_days)
        & (F.col("cv") > limits.autoscale_min_cv)
        & (F.col("cost") > F.lit(limits.autoscale_min_usd))
    )
    fixed_size = latest_clusters(clusters).where(
        F.col("min_autoscale_workers").isNull()
        & (F.col("worker_count") >= limits.autoscale_min_workers)
    ).select(
        "cluster_id", "cluster_name", "owned_by", "worker_count",
        "min_autoscale_workers", "max_autoscale_workers",
    )
    candidates = varying.join(fixed_size, "cluster_id").select(
        "cluster_id", "cluster_name", "workspace_id", "owned_by", "worker_count",
        "min_autoscale_workers", "max_autoscale_workers",
        rounded("cv").alias("coefficient_of_variation"),
        rounded("cost").alias("total_cost_usd"),
        "active_days",
    )
    found = _recommend(
        candidates, ENABLE_AUTOSCALE, days, limits.autoscale_factor, "MEDIUM",
        F.format_string(AUTOSCALE_TITLE, short_name("cluster_name", "cluster_id")),
        F.format_string(
            AUTOSCALE_RATIONALE, F.col("worker_count"), shortest("coefficient_of_variation")
        ),
    )
    return in_order(found, ordered, F.desc("total_cost_usd"), "cluster_id", "workspace_id")


def recommend_photon(
    silver: DataFrame,
    as_of: date,
    days: int = 7,
    min_dbu: float = DEFAULTS.photon_min_dbu,
    limits: Thresholds = DEFAULTS,
    ordered: bool = True,
) -> DataFrame:
    """Warehouse workloads on SKUs without the vectorised engine."""
    workloads = (
        silver.where(
            F.col("warehouse_id").isNotNull()
            & last_days(as_of, days)
            & ~F.lower("sku_name").contains("photon")
            & F.lower("billing_origin_product").isin(*PHOTON_PRODUCTS)
        )
        .groupBy("warehouse_id", "workspace_id", "sku_name")
        .agg(
            rounded(F.sum("estimated_cost_usd")).alias("total_cost_usd"),
            rounded(F.sum("usage_quantity")).alias("total_dbu"),
            F.count_distinct("usage_date").alias("active_days"),
        )
        .where(F.col("total_dbu") >= min_dbu)
    )
    found = _recommend(
        workloads, ENABLE_PHOTON, days, limits.photon_factor, "MEDIUM",
        F.format_string(PHOTON_TITLE, F.substring("warehouse_id", 1, SHORT_ID)),
        F.format_string(PHOTON_RATIONALE, shortest("total_cost_usd"), F.lit(days)),
    )
    return in_order(
        found, ordered, F.desc("total_cost_usd"), "warehouse_id", "workspace_id", "sku_name"
    )


def recommend_serverless(
    silver: DataFrame,
    as_of: date,
    days: int = 14,
    top_n: int | None = None,
    limits: Thresholds = DEFAULTS,
    ordered: bool = True,
) -> DataFrame:
    """Recurring jobs made of cheap records, costliest first; with `top_n` only so many."""
    cost = F.col("estimated_cost_usd")
    jobs = (
        silver.where(
            F.col("job_id").isNotNull()
            & last_days(as_of, days)
            & ~F.lower("sku_name").contains("serverless")
        )
        .groupBy("job_id", "workspace_id")
        .agg(
            F.count_distinct("usage_date").alias("active_days"),
            rounded(F.sum(cost)).alias("total_cost_usd"),
            rounded(mean_of(F.sum(cost), F.count(cost))).alias("avg_per_run_cost"),
            rounded(F.sum("usage_quantity")).alias("total_dbu"),
        )
        .where(
            (F.col("total_cost_usd") > limits.serverless_min_usd)
            & (F.col("avg_per_run_cost") < limits.serverless_max_record_usd)
        )
    )
    order = (F.desc("total_cost_usd"), "job_id", "workspace_id")
    if top_n is not None:
        jobs = jobs.orderBy(*order).limit(top_n)
    found = _recommend(
        jobs, MIGRATE_SERVERLESS, days, limits.serverless_factor, "LOW",
        F.format_string(SERVERLESS_TITLE, F.col("job_id")),
        F.format_string(SERVERLESS_RATIONALE, shortest("avg_per_run_cost")),
    )
    return in_order(found, ordered, *order)


# The resource each kind is about: its type, id column, name column, and the
# columns besides the workspace that tell two recommendations on it apart.
RESOURCE_OF = {
    RIGHT_SIZE: ("cluster", "cluster_id", "cluster_name", ()),
    ENABLE_AUTOSCALE: ("cluster", "cluster_id", "cluster_name", ()),
    ENABLE_PHOTON: ("warehouse", "warehouse_id", None, ("sku_name",)),
    MIGRATE_SERVERLESS: ("job", "job_id", None, ()),
}


def in_common_schema(df: DataFrame, kind: str) -> DataFrame:
    """One schema for all kinds, and an id made from what the row is about."""
    resource_type, id_column, name, more = RESOURCE_OF[kind]
    identity = F.concat_ws("|", "recommendation_type", id_column, "workspace_id", *more)
    return df.select(
        "*",
        F.sha2(identity, 256).alias("recommendation_id"),
        F.lit(resource_type).alias("resource_type"),
        F.col(id_column).alias("resource_id"),
        (F.col(name) if name else F.lit(None).cast("string")).alias("resource_name"),
    ).select("recommendation_id", *COMMON)


def all_recommendations(by_kind: dict[str, DataFrame]) -> DataFrame:
    result = None
    for kind, df in by_kind.items():
        part = in_common_schema(df, kind)
        result = part if result is None else result.unionByName(part)
    return result
