"""Markdown reports as rows of lines, and their assembly into one text.

A report is a DataFrame of (report, section, seq, line). Each is a handful of
lines: top-n lists, one row per severity and totals. The lists behind them may be
of any size; they are cut to their top rows before anything reaches one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costwright.functions.formats import fmt_usd, table_row, truncate
from costwright.functions.money import plain

# Headings, markers and wording of the reports.
COST_HEADING = "## 💰 Cost Summary (last %s days)\n"
TOTAL_LINE = "**Total spend:** %s  "
AVERAGE_LINE = "**Avg daily:** %s  "
WINDOW_LINE = "**Window:** %s → %s\n"
PRODUCT_HEADING = "\n### By Product"
PRODUCT_COLUMNS = ("Product", "Cost (USD)", "Records")
USER_HEADING = "\n### Top 5 Users"
USER_COLUMNS = ("User", "Cost (USD)", "Avg/day")
TREND_HEADING = "\n### Trend"
LATEST_LINE = "Latest period: %s"
CHANGE_LINE = "%s Latest period: %s (%s%% vs prior)"
UP, DOWN, FLAT = "📈", "📉", "➡️"
FINDINGS_HEADING = "## 🚨 Findings (%d total)\n"
NO_FINDINGS = "## 🚨 Findings\n\n_No anomalies or policy violations detected._"
SEVERITY_HEADING = "\n### %s %s (%d)"
SEVERITIES = {"CRITICAL": "🔥", "HIGH": "⚠️", "MEDIUM": "🟡", "LOW": "ℹ️"}
MORE_FINDINGS = "- _...and %d more_"
RECOMMENDATIONS_HEADING = "## 💡 Optimization Recommendations (%d total)"
SAVINGS_LINE = "\n**Estimated total monthly savings: %s**\n"
NO_RECOMMENDATIONS = "## 💡 Recommendations\n\n_No optimization opportunities found._"
TITLE_LINE = "\n**%d. %s**  "
DETAIL_LINE = "_Savings:_ %s/mo · _Confidence:_ %s  "
MORE_RECOMMENDATIONS = "\n_...and %d more_"
MORE_PRODUCTS = "_...and %d more_"

FINDINGS_PER_SEVERITY = 10
RECOMMENDATIONS_SHOWN = 15
USERS_SHOWN = 5
PRODUCTS_SHOWN = 10
TITLE_SHOWN = 200


def _lines(df: DataFrame, report: str, section, texts: Column, first_seq=0) -> DataFrame:
    """Explode an array of texts into lines; a NULL text is no line."""

    def number(value):
        return (value if isinstance(value, Column) else F.lit(value)).cast("int")

    numbered = df.select(
        number(section).alias("section"),
        number(first_seq).alias("first"),
        F.posexplode(texts).alias("pos", "line"),
    )
    return numbered.where(F.col("line").isNotNull()).select(
        F.lit(report).alias("report"),
        "section",
        (F.col("first") + F.col("pos")).alias("seq"),
        "line",
    )


def _table(df: DataFrame, order: list, heading: str, columns: tuple, cells: list) -> DataFrame:
    """A numbered table; its first row brings the heading along."""
    rank = F.row_number().over(Window.orderBy(*order))
    row = table_row(*cells)
    top = [F.lit(heading), F.lit("| " + " | ".join(columns) + " |"),
           F.lit("| " + " | ".join(["---"] * len(columns)) + " |"), row]
    return df.select(
        rank.alias("rank"),
        F.when(rank == 1, F.array(*top)).otherwise(F.array(row)).alias("texts"),
    )


def cost_summary_report(
    total: DataFrame, by_product: DataFrame, top_users: DataFrame, trend: DataFrame
) -> DataFrame:
    """`total` is one row, `by_product` all products, `top_users` a top-n list, `trend` periods."""
    name = "cost_summary"

    def day(column):
        return F.coalesce(F.col(column).cast("string"), F.lit("None"))

    head = _lines(total, name, 0, F.array(
        F.format_string(COST_HEADING, F.col("days").cast("string")),
        F.format_string(TOTAL_LINE, fmt_usd("total_cost_usd")),
        F.format_string(AVERAGE_LINE, fmt_usd("avg_daily_cost_usd")),
        F.format_string(WINDOW_LINE, day("first_date"), day("last_date")),
    ))
    product = F.coalesce(F.nullif("dimension_value", F.lit("")), F.lit("(unknown)"))
    product_order = [F.desc("total_cost_usd"), "dimension_value"]
    products = _table(
        by_product.orderBy(*product_order).limit(PRODUCTS_SHOWN), product_order,
        PRODUCT_HEADING, PRODUCT_COLUMNS,
        [product, fmt_usd("total_cost_usd"), F.format_number("record_count", 0)],
    )
    more_products = by_product.agg((F.count("*") - PRODUCTS_SHOWN).alias("more")).where("more > 0")
    user = truncate(F.coalesce(F.nullif("user_email", F.lit("")), F.lit("unknown")), 40)
    user_order = [F.desc("total_cost_usd"), "user_email"]
    users = _table(
        top_users.orderBy(*user_order).limit(USERS_SHOWN), user_order,
        USER_HEADING, USER_COLUMNS,
        [user, fmt_usd("total_cost_usd"), fmt_usd("avg_daily_cost_usd")],
    )
    latest = trend.agg(
        F.count("*").alias("periods"),
        F.max_by(F.struct("total_cost_usd", "pct_change_vs_prior"), "period").alias("latest"),
    ).where("periods >= 2").select("latest.*")
    change, cost = F.col("pct_change_vs_prior"), fmt_usd("total_cost_usd")
    marker = F.when(change > 0, UP).when(change < 0, DOWN).otherwise(FLAT)
    latest_line = F.when(change.isNull(), F.format_string(LATEST_LINE, cost)).otherwise(
        F.format_string(CHANGE_LINE, marker, cost, plain(change, 1))
    )
    rank = F.col("rank") * 10
    return (
        head.unionByName(_lines(products, name, 1, F.col("texts"), rank))
        .unionByName(_lines(more_products, name, 1, F.array(
            F.format_string(MORE_PRODUCTS, "more")), (PRODUCTS_SHOWN + 1) * 10))
        .unionByName(_lines(users, name, 2, F.col("texts"), rank))
        .unionByName(_lines(latest, name, 3, F.array(F.lit(TREND_HEADING), latest_line)))
    )


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def findings_report(findings: DataFrame) -> DataFrame:
    """Findings by severity, costliest first, ten of each and the number left out.

    Reads its input twice: once for the counts, once for the top rows.
    """
    name = "findings"
    daily = _optional(findings, "daily_cost_usd", "double")
    total = _optional(findings, "total_cost_usd", "double")
    pct = _optional(findings, "pct_above_baseline", "double")
    target = _optional(findings, "dim_value", "string")
    headline = F.coalesce(
        F.nullif(_optional(findings, "headline", "string"), F.lit("")),
        F.nullif(_optional(findings, "finding_type", "string"), F.lit("")),
        F.lit("Finding"),
    )
    extras = F.concat_ws(
        "; ",
        F.when(daily != 0, F.concat(F.lit("cost: "), fmt_usd(daily))),
        F.when(pct != 0, F.concat(F.lit("+"), plain(pct, 1), F.lit("% vs baseline"))),
        F.when(target != "", F.concat(F.lit("target: "), truncate(target, 30))),
    )
    suffix = F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise("")
    items = findings.select(
        F.coalesce(_optional(findings, "severity", "string"), F.lit("LOW")).alias("severity"),
        F.coalesce(daily, total, F.lit(0.0)).alias("cost"),
        F.concat(F.lit("- **"), headline, F.lit("**"), suffix).alias("line"),
    )
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    section = F.array_position(order, F.col("severity")).cast("int")
    marker = F.element_at(
        F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]),
        F.col("severity"),
    )
    by_cost = Window.partitionBy("severity").orderBy(F.desc("cost"), "line")
    shown = (
        items.where(F.col("severity").isin(*SEVERITIES))
        .withColumn("rank", F.row_number().over(by_cost))
        .where(F.col("rank") <= FINDINGS_PER_SEVERITY)
    )
    counts = items.groupBy("severity").agg(F.count("*").alias("n"))
    listed = counts.where(F.col("severity").isin(*SEVERITIES))
    left_out = F.col("n") - FINDINGS_PER_SEVERITY
    all_of_them = counts.agg(F.sum("n").alias("n"))
    head = F.when(F.col("n").isNull(), NO_FINDINGS).otherwise(
        F.format_string(FINDINGS_HEADING, F.col("n"))
    )
    return (
        _lines(all_of_them, name, 0, F.array(head))
        .unionByName(_lines(listed, name, section, F.array(
            F.format_string(SEVERITY_HEADING, marker, F.col("severity"), F.col("n")))))
        .unionByName(_lines(shown, name, section, F.array("line"), F.col("rank")))
        .unionByName(_lines(listed.where(left_out > 0), name, section, F.array(
            F.format_string(MORE_FINDINGS, left_out)), FINDINGS_PER_SEVERITY + 1))
    )


def recommendations_report(recommendations: DataFrame) -> DataFrame:
    """The fifteen largest savings, the total over all, and the number left out.

    Reads its input twice (totals and top rows), so stage a costly one first.
    """
    name = "recommendations"
    savings = F.coalesce("expected_savings_usd_monthly", F.lit(0.0))
    title = F.coalesce(
        F.nullif("title", F.lit("")), F.nullif("recommendation_type", F.lit("")),
        F.lit("Recommendation"),
    )
    order = [F.desc("savings"), "title", "rationale"]
    top = (
        recommendations.select(
            savings.alias("savings"),
            title.alias("title"),
            F.coalesce("confidence", F.lit("MEDIUM")).alias("confidence"),
            F.coalesce("rationale", F.lit("")).alias("rationale"),
        )
        .orderBy(*order)
        .limit(RECOMMENDATIONS_SHOWN)
        .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    )
    totals = recommendations.agg(
        F.count("*").alias("n"), F.sum(savings.cast("decimal(28,8)")).alias("savings")
    )
    left_out = F.col("n") - RECOMMENDATIONS_SHOWN
    head = F.when(F.col("n") == 0, F.array(F.lit(NO_RECOMMENDATIONS))).otherwise(F.array(
        F.format_string(RECOMMENDATIONS_HEADING, F.col("n")),
        F.format_string(SAVINGS_LINE, fmt_usd("savings")),
    ))
    item = F.array(
        F.format_string(TITLE_LINE, F.col("rank"), F.substring("title", 1, TITLE_SHOWN)),
        F.format_string(DETAIL_LINE, fmt_usd("savings"), F.col("confidence")),
        F.when(F.col("rationale") != "", F.col("rationale")),
    )
    return (
        _lines(totals, name, 0, head)
        .unionByName(_lines(top, name, 1, item, F.col("rank") * 10))
        .unionByName(_lines(totals.where(left_out > 0), name, 2, F.array(
            F.format_string(MORE_RECOMMENDATIONS, left_out))))
    )


def report_text(lines: DataFrame) -> DataFrame:
    """One markdown text per report."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "seq", "line")))
    return lines.groupBy("report").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("markdown")
    )
