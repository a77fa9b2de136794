"""Tag and node-type policy."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.functions.common import in_order
from costwright.functions.dates import last_days
from costwright.functions.money import rounded
from costwright.operators.optimize import short_name
from costwright.plans.gold import latest_clusters
from costwright.plans.silver import UNTAGGED, resource_id_of_record, resource_type_of_record
from costwright.thresholds import DEFAULTS, Thresholds

# Finding types and wording.
UNTAGGED_RESOURCE = "UNTAGGED_RESOURCE"
EXPENSIVE_NODE = "EXPENSIVE_NODE_TYPE"
UNTAGGED_HEADLINE = "%s missing tags: %s"
EXPENSIVE_HEADLINE = "Cluster %s uses expensive node type %s"
EXPENSIVE_ACTION = "Verify workload requires this size; consider downgrading to a smaller VM."
NO_COST_MESSAGE = "No cost data to evaluate"
# The tags a resource must carry, in the order they are reported.
REQUIRED = {
    "Environment": "tag_environment",
    "Project": "tag_project",
    "Team": "tag_team",
}
# The tags the compliance score averages over.
SCORED = {
    "environment": "tag_environment",
    "project": "tag_project",
    "team": "tag_team",
    "owner": "tag_owner",
}


def lacks_required_tag() -> Column:
    missing = F.lit(False)
    for column in REQUIRED.values():
        missing = missing | (F.col(column) == UNTAGGED)
    return missing


def untagged_resources(
    silver: DataFrame,
    as_of: date,
    days: int = 7,
    min_cost_usd: float = DEFAULTS.untagged_min_usd,
    top_n: int | None = None,
    limits: Thresholds = DEFAULTS,
    ordered: bool = True,
) -> DataFrame:
    """The resources that lack a required tag, costliest first; with `top_n` only so many.

    Tags are constant within a group, so they are tested before the grouping and
    tagged usage is never shuffled.
    """
    missing = [F.when(F.col(c) == UNTAGGED, tag) for tag, c in REQUIRED.items()]
    groups = (
        silver.where(last_days(as_of, days) & lacks_required_tag())
        .groupBy(
            "workspace_id",
            resource_id_of_record().alias("resource_id"),
            resource_type_of_record().alias("resource_type"),
            *REQUIRED.values(),
            "tag_costcenter",
        )
        .agg(F.sum("estimated_cost_usd").alias("cost"))
        .where(F.col("cost") >= F.lit(min_cost_usd))
    )
    cost = F.col("total_cost_usd")
    found = (
        groups.withColumn("total_cost_usd", rounded("cost"))
        .drop("cost")
        .withColumn("missing_tags", F.array_compact(F.array(*missing)))
        .withColumn("missing_count", F.size("missing_tags").cast("long"))
        .withColumn("finding_type", F.lit(UNTAGGED_RESOURCE))
        .withColumn(
            "severity",
            F.when(cost > limits.untagged_high_usd, "HIGH")
            .when(cost > limits.untagged_medium_usd, "MEDIUM")
            .otherwise("LOW"),
        )
        .withColumn(
            "headline",
            F.format_string(
                UNTAGGED_HEADLINE, F.col("resource_type"), F.array_join("missing_tags", ", ")
            ),
        )
    )
    found = in_order(
        found, ordered or top_n is not None,
        F.desc("total_cost_usd"), "workspace_id", "resource_type", "resource_id",
        *REQUIRED.values(), "tag_costcenter",
    )
    return found if top_n is None else found.limit(top_n)


def expensive_node_types(
    silver: DataFrame,
    clusters: DataFrame,
    as_of: date,
    days: int = 7,
    node_types: tuple[str, ...] = DEFAULTS.expensive_node_types,
) -> DataFrame:
    """Clusters whose workers or driver run on a listed node type."""
    costs = (
        silver.where(F.col("cluster_id").isNotNull() & last_days(as_of, days))
        .groupBy("cluster_id", "workspace_id")
        .agg(rounded(F.sum("estimated_cost_usd")).alias("total_cost_usd"))
    )
    listed = latest_clusters(clusters).where(
        F.col("worker_node_type").isin(*node_types) | F.col("driver_node_type").isin(*node_types)
    ).select(
        "cluster_id", "cluster_name", "owned_by", "worker_node_type", "driver_node_type",
        "worker_count",
    )
    headline = F.format_string(
        EXPENSIVE_HEADLINE,
        short_name("cluster_name", "cluster_id"),
        F.coalesce("worker_node_type", F.lit("None")),
    )
    return (
        costs.join(listed, "cluster_id")
        .select(
            "cluster_id", "cluster_name", "workspace_id", "owned_by",
            "worker_node_type", "driver_node_type", "worker_count", "total_cost_usd",
            F.lit(EXPENSIVE_NODE).alias("finding_type"),
            F.lit("MEDIUM").alias("severity"),
            headline.alias("headline"),
            F.lit(EXPENSIVE_ACTION).alias("recommended_action"),
        )
        .orderBy(F.desc("total_cost_usd"), "cluster_id", "workspace_id")
    )


def tag_compliance(silver: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """One row: the share of cost that carries each scored tag, and their mean."""
    cost = F.col("estimated_cost_usd")
    tagged = [
        F.coalesce(rounded(F.sum(F.when(F.col(column) != UNTAGGED, cost))), F.lit(0.0)).alias(name)
        for name, column in SCORED.items()
    ]
    sums = silver.where(last_days(as_of, days)).agg(
        F.coalesce(rounded(F.sum(cost)), F.lit(0.0)).alias("total"), *tagged
    )
    total = F.nullif("total", F.lit(0.0))
    shares = {name: F.col(name) / total * 100 for name in SCORED}
    mean = (shares["environment"] + shares["project"] + shares["team"] + shares["owner"]) / 4
    return sums.select(
        F.coalesce(rounded(mean, 1), F.lit(100.0)).alias("compliance_score"),
        *[
            rounded(share, 1).alias(f"pct_cost_with_{name}_tag")
            for name, share in shares.items()
        ],
        rounded(total - F.col("environment")).alias("untagged_cost_usd"),
        total.alias("total_cost_usd"),
        F.when(total.isNull(), NO_COST_MESSAGE).alias("message"),
    )
