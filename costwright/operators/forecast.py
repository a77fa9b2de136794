"""Month-end projection and budget burn."""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwright.functions.dates import month_to_date
from costwright.functions.money import exact_round, mean_of, rounded
from costwright.thresholds import DEFAULTS, Thresholds

# The method name and the wording of the alert messages.
LINEAR = "linear_avg_daily"
OVERRUN_MESSAGE = "Projected overrun: $%s above $%s budget"
BURNING_MESSAGE = "Burning fast: %s%% of budget used at %s%% of month"
CAP_MESSAGE = "Approaching budget cap (%s%% used)"
ON_TRACK_MESSAGE = "On track (%s%% of budget at %s%% of month)"


def _projection(spend: DataFrame, as_of: date, *keys: str) -> DataFrame:
    """`spend` has exact `mtd` and `days_with_data` per key; projects it linearly."""
    days_in_month = monthrange(as_of.year, as_of.month)[1]
    remaining = days_in_month - as_of.day
    return (
        spend.withColumn("mtd", F.coalesce(rounded("mtd"), F.lit(0.0)))
        .withColumn("avg_daily", F.coalesce(mean_of("mtd", "days_with_data"), F.lit(0.0)))
        .select(
            *keys,
            F.col("mtd").alias("mtd_total_usd"),
            rounded("avg_daily").alias("avg_daily_cost_usd"),
            F.lit(as_of.day).cast("long").alias("days_elapsed"),
            F.lit(remaining).cast("long").alias("days_remaining"),
            F.lit(days_in_month).cast("long").alias("days_in_month"),
            rounded(F.col("mtd") + F.col("avg_daily") * F.lit(float(remaining))).alias(
                "projected_month_end_usd"
            ),
            F.lit(LINEAR).alias("projection_method"),
        )
    )


def _spend_measures():
    return [
        F.sum("total_cost_usd").alias("mtd"),
        F.count_distinct("usage_date").alias("days_with_data"),
    ]


def month_end_projection(
    daily_cost: DataFrame, as_of: date, workspace_id: str | None = None
) -> DataFrame:
    """One row: month to date plus the daily mean over dates with data for the rest."""
    month = daily_cost.where(month_to_date(as_of))
    if workspace_id is not None:
        month = month.where(F.col("workspace_id") == workspace_id)
    return _projection(month.agg(*_spend_measures()), as_of).withColumn(
        "workspace_id", F.lit(workspace_id).cast("string")
    )


def month_end_projection_by_workspace(daily_cost: DataFrame, as_of: date) -> DataFrame:
    month = daily_cost.where(month_to_date(as_of))
    return _projection(
        month.groupBy("workspace_id").agg(*_spend_measures()), as_of, "workspace_id"
    )


def burn_rate(
    daily_cost: DataFrame,
    budgets: DataFrame,
    as_of: date,
    limits: Thresholds = DEFAULTS,
) -> DataFrame:
    """Month-to-date spend against each budget (`workspace_id`, `monthly_budget_usd`).

    A budget without a workspace covers the whole account. One rollup gives both
    the workspaces and the account.
    """
    spend = (
        daily_cost.where(month_to_date(as_of))
        .rollup("workspace_id")
        .agg(*_spend_measures(), F.grouping("workspace_id").alias("is_account"))
        .where((F.col("is_account") == 1) | F.col("workspace_id").isNotNull())
    )
    by_scope = _projection(spend, as_of, "workspace_id").alias("p")
    b = budgets.alias("b")
    same_scope = F.col("b.workspace_id").eqNullSafe(F.col("p.workspace_id"))

    days_in_month = monthrange(as_of.year, as_of.month)[1]
    budget = F.col("monthly_budget_usd").cast("double")
    spent = F.coalesce("mtd_total_usd", F.lit(0.0))
    projected = F.coalesce("projected_month_end_usd", F.lit(0.0))
    compared = b.join(by_scope, same_scope, "left").select(
        "b.workspace_id",
        budget.alias("monthly_budget_usd"),
        spent.alias("mtd_spend_usd"),
        projected.alias("projected_month_end_usd"),
        F.when(budget > 0, spent / budget * 100).otherwise(0.0).alias("consumed"),
        F.lit(as_of.day / days_in_month * 100).alias("elapsed"),
        F.when(budget > 0, (projected - budget) / budget * 100).otherwise(0.0).alias("overrun"),
    )

    def whole(value):
        return exact_round(value, 0).cast("decimal(20,0)").cast("string")

    def dollars(value):
        return F.format_number(exact_round(value, 0), 0)

    over = F.col("overrun") >= limits.overrun_pct
    near_cap = F.col("consumed") >= limits.budget_alert_pct
    early = F.col("elapsed") < limits.budget_alert_pct
    level = (
        F.when(over, "CRITICAL").when(near_cap & early, "HIGH").when(near_cap, "MEDIUM")
        .otherwise("OK")
    )
    above = F.col("projected_month_end_usd") - F.col("monthly_budget_usd")
    message = (
        F.when(over, F.format_string(
            OVERRUN_MESSAGE, dollars(above), dollars(F.col("monthly_budget_usd"))))
        .when(near_cap & early, F.format_string(
            BURNING_MESSAGE, whole("consumed"), whole("elapsed")))
        .when(near_cap, F.format_string(CAP_MESSAGE, whole("consumed")))
        .otherwise(F.format_string(ON_TRACK_MESSAGE, whole("consumed"), whole("elapsed")))
    )
    return compared.select(
        "workspace_id",
        "monthly_budget_usd",
        "mtd_spend_usd",
        "projected_month_end_usd",
        rounded("consumed", 1).alias("pct_budget_consumed"),
        rounded("elapsed", 1).alias("pct_month_elapsed"),
        rounded("overrun", 1).alias("pct_projected_overrun"),
        level.alias("alert_level"),
        message.alias("message"),
    )
