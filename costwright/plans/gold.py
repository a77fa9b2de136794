"""Gold layer: daily rollups of the silver table.

All are plain groupings: Spark aggregates on the map side first, so a hot user,
tag or resource reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwright.functions.money import rounded
from costwright.plans.silver import (
    resource_id_of_record,
    resource_type_of_record,
    user_of_record,
)

DAY_AND_WORKSPACE = ("usage_date", "workspace_id")


def _sums():
    return [
        F.sum("usage_quantity").alias("total_usage"),
        F.sum("estimated_cost_usd").alias("total_cost_usd"),
    ]


def daily_cost(silver: DataFrame) -> DataFrame:
    keys = (*DAY_AND_WORKSPACE, "sku_name", "billing_origin_product")
    return silver.groupBy(*keys).agg(*_sums(), F.count("*").alias("record_count"))


def cost_by_user(silver: DataFrame) -> DataFrame:
    """Summed by user and resource first, so that a distinct count is a count of groups; count_distinct
    would copy each row once for each of the three. A record of several resources has a row for
    each, of which the first carries the sums."""
    keys = (*DAY_AND_WORKSPACE, "user_email")
    kinds = ("cluster", "warehouse", "job")
    resources = F.array(
        *(F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id")) for kind in kinds)
    )
    known = F.posexplode_outer(F.filter(resources, lambda r: r["id"].isNotNull()))
    by_resource = (
        silver.select(
            *DAY_AND_WORKSPACE, user_of_record().alias("user_email"),
            "usage_quantity", "estimated_cost_usd", known.alias("place", "resource"),
        )
        .withColumns({
            c: F.when(F.coalesce("place", F.lit(0)) == 0, F.col(c))
            for c in ("usage_quantity", "estimated_cost_usd")
        })
        .groupBy(*keys, F.col("resource.kind").alias("kind"), F.col("resource.id").alias("id"))
        .agg(*_sums())
    )
    types = dict(by_resource.dtypes)
    return by_resource.groupBy(*keys).agg(
        *(F.sum(c).cast(types[c]).alias(c) for c in ("total_usage", "total_cost_usd")),
        *(F.count_if(F.col("kind") == kind).alias(f"distinct_{kind}s") for kind in kinds),
    )


def cost_by_tags(silver: DataFrame) -> DataFrame:
    tags = ("tag_environment", "tag_project", "tag_team", "tag_costcenter")
    return silver.groupBy(*DAY_AND_WORKSPACE, *tags).agg(
        *_sums(), F.count("*").alias("record_count")
    )


def cost_by_resource(silver: DataFrame) -> DataFrame:
    return silver.groupBy(
        *DAY_AND_WORKSPACE,
        resource_type_of_record().alias("resource_type"),
        resource_id_of_record().alias("resource_id"),
    ).agg(*_sums(), F.count("*").alias("record_count"))


def daily_totals(daily: DataFrame) -> DataFrame:
    """One exact total per date."""
    return daily.groupBy("usage_date").agg(F.sum("total_cost_usd").alias("total_cost_usd"))


def latest_daily_totals(daily: DataFrame, newest: int = 14) -> DataFrame:
    return (
        daily_totals(daily)
        .orderBy(F.desc("usage_date"))
        .limit(newest)
        .select("usage_date", rounded("total_cost_usd", 8).alias("daily_total_usd"))
    )


def latest_clusters(clusters: DataFrame) -> DataFrame:
    """The newest version of each cluster's configuration.

    Spark turns the rank filter into a group limit before the shuffle, so a
    cluster with very many versions sends one row per task.
    """
    newest_first = Window.partitionBy("cluster_id").orderBy(
        F.desc("change_time"), F.desc("create_time"), "cluster_name", "workspace_id"
    )
    ranked = clusters.withColumn("_version", F.row_number().over(newest_first))
    return ranked.where("_version = 1").drop("_version")
