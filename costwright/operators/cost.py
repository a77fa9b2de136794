"""Cost questions: totals, breakdowns, top spenders and trends."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwright.functions.common import choose
from costwright.functions.dates import last_days
from costwright.functions.money import mean_of, rounded
from costwright.plans.silver import user_of_record


def _totals(grouped, days: int) -> DataFrame:
    return grouped.agg(
        rounded(F.sum("total_cost_usd")).alias("total_cost_usd"),
        rounded(mean_of(F.sum("total_cost_usd"), F.lit(days))).alias("avg_daily_cost_usd"),
        F.min("usage_date").alias("first_date"),
        F.max("usage_date").alias("last_date"),
        F.count_distinct("usage_date").alias("days_with_data"),
    ).withColumn("days", F.lit(days).cast("long"))


def total_cost(
    daily_cost: DataFrame, as_of: date, days: int = 7, workspace_id: str | None = None
) -> DataFrame:
    """One row. The average divides by `days`, not by the dates that have data."""
    window = daily_cost.where(last_days(as_of, days))
    if workspace_id is not None:
        window = window.where(F.col("workspace_id") == workspace_id)
    return _totals(window.groupBy(), days).withColumn(
        "workspace_id", F.lit(workspace_id).cast("string")
    )


def total_cost_by_workspace(daily_cost: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """`total_cost` of every workspace at once."""
    return _totals(daily_cost.where(last_days(as_of, days)).groupBy("workspace_id"), days)


def cost_breakdown(
    silver: DataFrame, dimension: str, as_of: date, days: int = 7, top_n: int | None = 10
) -> DataFrame:
    """The `top_n` values of a dimension by cost (None: all); values without cost are left out."""
    value = choose(
        {
            "sku": F.col("sku_name"),
            "product": F.col("billing_origin_product"),
            "user": user_of_record(),
            "team": F.col("tag_team"),
            "project": F.col("tag_project"),
            "environment": F.col("tag_environment"),
            "workspace": F.col("workspace_id"),
        },
        dimension,
        "dimension",
    )
    by_value = (
        silver.where(last_days(as_of, days))
        .groupBy(value.alias("dimension_value"))
        .agg(
            F.sum("estimated_cost_usd").alias("cost"),
            F.sum("usage_quantity").alias("usage"),
            F.count("*").alias("record_count"),
        )
    )
    found = (
        by_value.where("cost > 0")
        .select(
            "dimension_value",
            rounded("cost").alias("total_cost_usd"),
            rounded("usage").alias("total_usage"),
            "record_count",
            F.lit(dimension).alias("dimension"),
        )
        .orderBy(F.desc("total_cost_usd"), "dimension_value")
    )
    return found if top_n is None else found.limit(top_n)


def top_spending_users(
    cost_by_user: DataFrame, as_of: date, days: int = 7, top_n: int = 10
) -> DataFrame:
    """The average is over rows of the daily rollup: one per date and workspace."""
    by_user = (
        cost_by_user.where(last_days(as_of, days))
        .groupBy("user_email")
        .agg(
            rounded(F.sum("total_cost_usd")).alias("total_cost_usd"),
            rounded(mean_of(F.sum("total_cost_usd"), F.count("total_cost_usd"))).alias(
                "avg_daily_cost_usd"
            ),
            F.sum("distinct_clusters").alias("cluster_uses"),
            F.sum("distinct_warehouses").alias("warehouse_uses"),
            F.sum("distinct_jobs").alias("job_uses"),
        )
    )
    return (
        by_user.where("total_cost_usd > 0")
        .orderBy(F.desc("total_cost_usd"), "user_email")
        .limit(top_n)
    )


def top_spending_resources(
    cost_by_resource: DataFrame, as_of: date, days: int = 7, top_n: int = 10
) -> DataFrame:
    by_resource = (
        cost_by_resource.where(last_days(as_of, days) & (F.col("resource_id") != "unknown"))
        .groupBy("resource_type", "resource_id")
        .agg(
            rounded(F.sum("total_cost_usd")).alias("total_cost_usd"),
            rounded(mean_of(F.sum("total_cost_usd"), F.count("total_cost_usd"))).alias(
                "avg_daily_cost_usd"
            ),
            F.count_distinct("usage_date").alias("active_days"),
        )
    )
    return (
        by_resource.where("total_cost_usd > 0")
        .orderBy(F.desc("total_cost_usd"), "resource_type", "resource_id")
        .limit(top_n)
    )


def top_spenders(rollup: DataFrame, spender_type: str, as_of: date, **options) -> DataFrame:
    """`user` over the user rollup or `resource` over the resource rollup."""
    chosen = choose(
        {"user": top_spending_users, "resource": top_spending_resources},
        spender_type,
        "spender type",
    )
    return chosen(rollup, as_of, **options)


def cost_trend(
    daily_cost: DataFrame, as_of: date, days: int = 30, granularity: str = "day"
) -> DataFrame:
    """Cost per period and its change against the period before.

    The window over all periods sees at most `days + 1` rows: the cost is summed
    per period before it.
    """
    period = choose(
        {
            "day": F.col("usage_date"),
            "week": F.date_trunc("week", "usage_date").cast("date"),
            "month": F.date_trunc("month", "usage_date").cast("date"),
        },
        granularity,
        "granularity",
    )
    periods = (
        daily_cost.where(last_days(as_of, days))
        .groupBy(period.alias("period"))
        .agg(
            rounded(F.sum("total_cost_usd")).alias("total_cost_usd"),
            F.sum("record_count").alias("record_count"),
        )
    )
    prior = F.lag("total_cost_usd").over(Window.orderBy("period"))
    change = F.when(prior > 0, (F.col("total_cost_usd") - prior) / prior * 100)
    return periods.withColumn("pct_change_vs_prior", rounded(change, 1)).orderBy("period")
