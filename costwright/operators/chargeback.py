"""Priorities of recommendations and the monthly bill of each team."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwright.functions.common import in_order
from costwright.functions.money import rounded
from costwright.operators.policy import lacks_required_tag
from costwright.plans.silver import resource_id_of_record, resource_type_of_record

# Tiers by monthly savings. Each has its lower savings bound, the
# savings at which its score band ends, and the band itself.
TIERS = {
    "P0": (1000.0, 10000.0, 80.0, 100.0),
    "P1": (500.0, 1000.0, 60.0, 79.0),
    "P2": (100.0, 500.0, 40.0, 59.0),
    "P3": (0.0, 100.0, 0.0, 39.0),
}
DRIVERS = 3


def prioritize(recommendations: DataFrame, ordered: bool = True) -> DataFrame:
    """Score and tier by monthly savings, highest first.

    The score runs linearly through the tier's band. P0 has no upper savings
    bound; it reaches 100 at ten times its lower one. The result is sorted on the
    cluster and carries no row number, which would need all rows in one task.
    """
    savings = F.greatest(F.coalesce("expected_savings_usd_monthly", F.lit(0.0)), F.lit(0.0))

    tier, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (low, high, floor, top) in reversed(TIERS.items()):
        inside = savings > low if name == "P0" else savings >= low
        along = (F.least(savings, F.lit(high)) - low) / (high - low)
        tier = F.when(inside, name).otherwise(tier)
        score = F.when(inside, floor + along * (top - floor)).otherwise(score)
    scored = recommendations.withColumns(
        {"priority_score": rounded(score), "priority_tier": tier}
    )
    return in_order(
        scored, ordered, F.desc("priority_score"), F.desc(savings), "recommendation_id"
    )


def team_chargeback(
    silver: DataFrame, first_day: date | None = None, last_day: date | None = None
) -> DataFrame:
    """Per team and month: total, change, three largest resources, untagged cost.

    `first_day` and `last_day` say which days `silver` covers, if not all. A month
    that they cut has no change, nor has a month after one that they cut.
    Untagged cost lacks a required tag, as in the untagged-resources report. Totals and
    drivers read the same columns of the cost per resource, so Spark shuffles that once
    for both; the group limit then keeps three rows per team, month and task.
    """
    untagged = lacks_required_tag()
    cost = F.col("estimated_cost_usd")
    by_resource = silver.groupBy(
        "tag_team",
        "usage_month",
        resource_type_of_record().alias("resource_type"),
        resource_id_of_record().alias("resource_id"),
    ).agg(
        F.sum(cost).alias("cost"),
        F.coalesce(F.sum(F.when(untagged, cost)), F.lit(0)).alias("untagged"),
    )

    totals = by_resource.groupBy("tag_team", "usage_month").agg(
        rounded(F.sum("cost")).alias("total_cost_usd"),
        rounded(F.sum("untagged")).alias("untagged_cost_usd"),
    )
    by_month = Window.partitionBy("tag_team").orderBy("usage_month")
    prior = F.lag("total_cost_usd").over(by_month)
    prior_month = F.lag("usage_month").over(by_month)
    month_before = F.date_format(
        F.add_months(F.to_date("usage_month", "yyyy-MM"), -1), "yyyy-MM"
    )
    last_month = F.when(prior_month == month_before, prior)
    totals = totals.withColumn("last_month_cost_usd", last_month)
    month = F.to_date("usage_month", "yyyy-MM")
    whole = F.lit(True)
    if first_day is not None:
        whole = whole & (F.add_months(month, -1) >= F.lit(first_day))
    if last_day is not None:
        whole = whole & (F.last_day(month) <= F.lit(last_day))
    change = F.when(
        whole & (F.col("last_month_cost_usd") > 0),
        (F.col("total_cost_usd") - F.col("last_month_cost_usd"))
        / F.col("last_month_cost_usd") * 100,
    )

    largest = Window.partitionBy("tag_team", "usage_month").orderBy(
        F.desc("cost"), "resource_type", "resource_id"
    )
    drivers = (
        by_resource.where("cost > 0")
        .withColumn("rank", F.row_number().over(largest))
        .where(F.col("rank") <= DRIVERS)
        .groupBy("tag_team", "usage_month")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank", "resource_type", "resource_id",
                        rounded("cost").alias("cost_usd"),
                        rounded("untagged").alias("untagged_usd"),
                    )
                )
            ).alias("top_drivers")
        )
    )
    # Null-safe: a plain equality would add not-null filters to one side only, and the
    # two sides would no longer share their shuffle.
    t, d = totals.withColumn("pct_change_vs_last_month", rounded(change, 1)), drivers
    same = t["tag_team"].eqNullSafe(d["tag_team"]) & t["usage_month"].eqNullSafe(d["usage_month"])
    return t.join(d, same, "left").select(
        t["tag_team"].alias("team"), t["usage_month"], "total_cost_usd", "untagged_cost_usd",
        "last_month_cost_usd", "pct_change_vs_last_month", "top_drivers",
    )
