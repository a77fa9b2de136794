"""Headline metrics of a run and the findings drawn from them.

Everything here works on daily totals: at most one row per date of the lookback
window, summed on the cluster before any window over all dates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costwright.functions.dates import last_days
from costwright.functions.money import mean_of, plain, rounded
from costwright.plans.gold import daily_totals
from costwright.thresholds import DEFAULTS, Thresholds

# Categories, resource names and wording of the findings.
ANOMALY, CONCENTRATION, TREND = "anomaly", "concentration", "trend"
WORKSPACE_TOTAL = "workspace_total"
ZSCORE_TITLE = "Daily cost %s on %s"
ZSCORE_DESCRIPTION = (
    "Daily cost was $%s, %s std devs from the %d-day mean of $%s."
)
CONCENTRATION_TITLE = "High concentration in SKU %s"
CONCENTRATION_DESCRIPTION = (
    "%s%% of total spend comes from a single SKU. "
    "Diversification or commitment discounts may be appropriate."
)
TREND_TITLE = "Spend up %s%% week-over-week"
TREND_DESCRIPTION = "Last 7 days: $%s vs prior 7 days: $%s."
TINY = 1e-9

FINDING = [
    "finding_id", "category", "severity", "title", "description", "affected_resource",
    "metric_value", "baseline_value", "detected_at", "evidence",
]


def top_skus(daily_cost: DataFrame, as_of: date, days: int = 30, top_n: int = 10) -> DataFrame:
    return (
        daily_cost.where(last_days(as_of, days))
        .groupBy("sku_name")
        .agg(rounded(F.sum("total_cost_usd"), 8).alias("cost_usd"))
        .orderBy(F.desc("cost_usd"), "sku_name")
        .limit(top_n)
    )


def run_metrics(daily_cost: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """`summary_metrics` and the top SKU, in one row.

    Cost per date and SKU is the one shuffled input; totals per date and per SKU
    both start from it. They meet in a single aggregate, so nothing is joined.
    """
    by_date_and_sku = (
        daily_cost.where(last_days(as_of, days))
        .groupBy("usage_date", "sku_name")
        .agg(F.sum("total_cost_usd").alias("total_cost_usd"))
    )
    newest_first = Window.orderBy(F.desc("usage_date"))
    dates = daily_totals(by_date_and_sku).select(
        F.row_number().over(newest_first).alias("age"),
        F.col("total_cost_usd").alias("date_cost"),
        F.lit(None).cast("string").alias("sku_name"),
        F.lit(None).cast("decimal(38,8)").alias("sku_cost"),
    )
    skus = by_date_and_sku.groupBy("sku_name").agg(
        F.sum("total_cost_usd").cast("decimal(38,8)").alias("sku_cost")
    ).select(
        F.lit(None).cast("int").alias("age"),
        F.lit(None).cast("decimal(38,8)").alias("date_cost"),
        "sku_name",
        "sku_cost",
    )
    best_first = F.struct((-F.col("sku_cost")).alias("negated"), F.col("sku_name"))
    sums = dates.unionByName(skus).agg(
        F.sum("date_cost").alias("total"),
        F.count("age").alias("dates"),
        F.sum(F.when(F.col("age") <= 7, F.col("date_cost"))).alias("last_7"),
        F.sum(F.when(F.col("age").between(8, 14), F.col("date_cost"))).alias("prior_7"),
        F.max("sku_cost").alias("top_sku_cost"),
        F.min(F.when(F.col("sku_cost").isNotNull(), best_first))["sku_name"].alias("top_sku"),
    )
    last_7 = F.col("last_7").cast("double")
    prior_7 = F.when(F.col("dates") >= 14, F.col("prior_7").cast("double")).otherwise(0.0)
    wow = F.when(prior_7 > 0, (last_7 - prior_7) / prior_7 * 100).otherwise(0.0)
    total = F.col("total").cast("double")
    share = F.when(total > 0, F.col("top_sku_cost").cast("double") / total * 100).otherwise(0.0)
    any_data = F.col("dates") > 0

    def shown(value):
        return F.when(any_data, value)

    return sums.select(
        F.coalesce(rounded("total"), F.lit(0.0)).alias("total_cost_usd"),
        rounded(mean_of("total", "dates")).alias("avg_daily_cost_usd"),
        rounded("last_7").alias("last_7d_cost_usd"),
        shown(rounded(prior_7)).alias("prior_7d_cost_usd"),
        shown(rounded(wow)).alias("wow_change_pct"),
        shown(rounded(share)).alias("top_sku_share_pct"),
        shown(F.col("dates")).alias("lookback_days"),
        "top_sku",
        rounded("top_sku_cost", 8).alias("top_sku_cost_usd"),
    )


def summary_metrics(daily_cost: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """One row; without data only the total is set, to zero."""
    return run_metrics(daily_cost, as_of, days).drop("top_sku", "top_sku_cost_usd")


def _finding(df: DataFrame, as_of: date, category: str, **columns) -> DataFrame:
    identity = F.concat_ws("|", F.lit(category), columns["affected_resource"], columns["title"])
    return df.select(
        F.lit(category).alias("category"),
        F.lit(as_of).cast("timestamp").alias("detected_at"),
        F.sha2(identity, 256).alias("finding_id"),
        *[value.alias(name) for name, value in columns.items()],
    ).select(*FINDING)


def daily_zscore_anomalies(
    daily_cost: DataFrame,
    as_of: date,
    days: int = 30,
    zscore: float = DEFAULTS.zscore,
    min_cost_usd: float = DEFAULTS.spike_min_daily_usd,
    limits: Thresholds = DEFAULTS,
) -> DataFrame:
    """Dates whose total is far from the mean of the window, in sample deviations."""
    all_dates = Window.partitionBy()
    cost = F.col("total_cost_usd").cast("double")
    spread = F.stddev_samp(cost).over(all_dates)
    scored = (
        daily_totals(daily_cost.where(last_days(as_of, days)))
        .select(
            "usage_date",
            cost.alias("cost"),
            F.count("*").over(all_dates).alias("dates"),
            mean_of(
                F.sum("total_cost_usd").over(all_dates), F.count("*").over(all_dates)
            ).alias("mean"),
            F.when(spread > 0, spread).otherwise(F.lit(TINY)).alias("std"),
        )
        .withColumn("z", (F.col("cost") - F.col("mean")) / F.col("std"))
        .where(
            (F.col("dates") >= limits.zscore_min_days)
            & (F.abs("z") >= zscore)
            & (F.col("cost") >= min_cost_usd)
        )
    )
    direction = F.when(F.col("z") > 0, "spike").otherwise("drop")
    return _finding(
        scored, as_of, ANOMALY,
        severity=F.when(F.abs("z") >= limits.zscore_high, "high").otherwise("medium"),
        title=F.format_string(ZSCORE_TITLE, direction, F.col("usage_date").cast("string")),
        description=F.format_string(
            ZSCORE_DESCRIPTION, plain("cost"), plain(F.abs("z"), 1), F.lit(days), plain("mean")
        ),
        affected_resource=F.lit(WORKSPACE_TOTAL),
        metric_value=F.col("cost"),
        baseline_value=F.col("mean"),
        evidence=F.to_json(F.struct(F.col("z").alias("zscore"), "mean", "std")),
    )


def _concentration(share_pct: float) -> tuple[str, Column, dict[str, Column]]:
    share = F.col("top_sku_share_pct")
    return CONCENTRATION, share > share_pct, {
        "severity": F.lit("medium"),
        "title": F.format_string(CONCENTRATION_TITLE, F.col("top_sku")),
        "description": F.format_string(CONCENTRATION_DESCRIPTION, plain(share, 1)),
        "affected_resource": F.col("top_sku"),
        "metric_value": F.col("top_sku_cost_usd"),
        "baseline_value": F.col("total_cost_usd"),
        "evidence": F.to_json(F.struct(share.alias("share_pct"))),
    }


def _jump(wow_pct: float, limits: Thresholds) -> tuple[str, Column, dict[str, Column]]:
    change = F.col("wow_change_pct")
    return TREND, change >= wow_pct, {
        "severity": F.when(change >= limits.wow_high_pct, "high").otherwise("medium"),
        "title": F.format_string(TREND_TITLE, plain(change, 1)),
        "description": F.format_string(
            TREND_DESCRIPTION, plain("last_7d_cost_usd"), plain("prior_7d_cost_usd")
        ),
        "affected_resource": F.lit(WORKSPACE_TOTAL),
        "metric_value": F.col("last_7d_cost_usd"),
        "baseline_value": F.col("prior_7d_cost_usd"),
        "evidence": F.to_json(F.struct(change.alias("wow_change_pct"))),
    }


def _from_metrics(metrics: DataFrame, as_of: date, *rules) -> DataFrame:
    """One pass over the one row of metrics: a struct per rule that applies, exploded."""
    found = [
        F.when(applies, F.struct(
            F.lit(category).alias("category"),
            F.lit(as_of).cast("timestamp").alias("detected_at"),
            F.sha2(F.concat_ws(
                "|", F.lit(category), columns["affected_resource"], columns["title"]
            ), 256).alias("finding_id"),
            *[columns[name].alias(name) for name in columns],
        ))
        for category, applies, columns in rules
    ]
    return metrics.select(F.inline(F.array_compact(F.array(*found)))).select(*FINDING)


def sku_concentration(
    metrics: DataFrame, as_of: date, share_pct: float = DEFAULTS.sku_share_pct
) -> DataFrame:
    """One finding when a single SKU takes more than `share_pct` of the spend."""
    return _from_metrics(metrics, as_of, _concentration(share_pct))


def wow_jump(
    metrics: DataFrame,
    as_of: date,
    wow_pct: float = DEFAULTS.wow_pct,
    limits: Thresholds = DEFAULTS,
) -> DataFrame:
    """One finding when the last seven dates cost much more than the seven before."""
    return _from_metrics(metrics, as_of, _jump(wow_pct, limits))


def metric_findings(
    metrics: DataFrame,
    as_of: date,
    share_pct: float = DEFAULTS.sku_share_pct,
    wow_pct: float = DEFAULTS.wow_pct,
    limits: Thresholds = DEFAULTS,
) -> DataFrame:
    """The findings of sku_concentration and wow_jump from one evaluation of the metrics."""
    return _from_metrics(metrics, as_of, _concentration(share_pct), _jump(wow_pct, limits))


def all_findings(*findings: DataFrame) -> DataFrame:
    """Findings of any operator in one schema, severities in upper case."""
    result = None
    for df in findings:
        result = df if result is None else result.unionByName(df, allowMissingColumns=True)
    return result.withColumn("severity", F.upper("severity"))
