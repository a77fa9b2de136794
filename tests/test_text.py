"""Formats, parsed responses and reports, against plain Python where it has an answer."""

import json
import re
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costwright.functions import formats
from costwright.operators import reports, responses
from rows import AS_OF, dicts, one


def shown(spark, function, values, kind="double", **options):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r["t"] for r in dicts(df.select(function("x", **options).alias("t")))]


def test_usd(spark):
    assert shown(spark, formats.fmt_usd, [None, 0.0, 1234.5, -1234.5, 0.005, 1e9, -0.001]) == [
        "$0.00", "$0.00", "$1,234.50", "$-1,234.50", "$0.01", "$1,000,000,000.00", "$0.00"]
    assert shown(spark, formats.fmt_usd, [1234.5], decimals=0) == ["$1,235"]


def test_pct(spark):
    assert shown(spark, formats.fmt_pct, [None, 0.13, -0.005, 12.0]) == [
        "N/A", "13.0%", "-0.5%", "1200.0%"]
    df = spark.createDataFrame([(100.0, 150.0), (100.0, 50.0), (-100.0, 50.0), (0.0, 1.0),
                                (None, 1.0), (5.0, None), (5.0, 5.0)], "a double, b double")
    got = [r["t"] for r in dicts(df.select(formats.fmt_pct_change("a", "b").alias("t")))]
    assert got == ["+50.0%", "-50.0%", "+150.0%", "N/A", "N/A", "N/A", "+0.0%"]


def test_dbu_and_bytes(spark):
    assert shown(spark, formats.fmt_dbu, [None, 999.94, 1000.0, 12345.0, -5000.0]) == [
        "0", "999.9 DBU", "1.0K DBU", "12.3K DBU", "-5000.0 DBU"]
    sizes = [None, 0.0, 1023.0, 1024.0, -2048.0, 1024.0**5, 1024.0**6, 3 * 1024.0**7]
    assert shown(spark, formats.fmt_bytes, sizes) == [
        "0 B", "0.00 B", "1023.00 B", "1.00 KB", "-2.00 KB", "1.00 PB", "1.00 EB", "3072.00 EB"]


def python_duration(seconds):
    if not seconds:
        return "0s"
    seconds = int(seconds)
    d, rest = divmod(seconds, 86400)
    clock = [(rest // 3600, "h"), (rest // 60 % 60, "m"), (0 if d else rest % 60, "s")]
    return " ".join(f"{n}{u}" for n, u in [(d, "d"), *clock] if n) or "0s"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.none() | st.floats(-1e6, 1e7) | st.sampled_from([0.0, 59.0, 3600.0, 86400.0]),
                min_size=1, max_size=40))
def test_duration(spark, values):
    assert shown(spark, formats.fmt_duration, values) == [python_duration(v) for v in values]


def test_truncate(spark):
    assert shown(spark, formats.truncate, ["abcdef", "abcdefg", "é" * 8, None], "string",
                 max_len=6) == ["abcdef", "abc...", "ééé...", None]


def test_table_row_escapes_pipes(spark):
    df = spark.createDataFrame([("a|b", "c")], "x string, y string")
    assert one(df.select(formats.table_row(F.col("x"), F.col("y")).alias("t")))["t"] == (
        "| a\\|b | c |")


# ------------------------------------------------------------- responses

FINDINGS = [("f1", "ws-1"), ("f2", "ws-2")]


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "response_id int, response_text string")
    findings = spark.createDataFrame(FINDINGS, "finding_id string, affected_resource string")
    return sorted(dicts(responses.parse_recommendations(df, findings, AS_OF)),
                  key=lambda r: (r["response_id"], r["title"]))


def test_defaults_for_null_and_missing(spark):
    nulls = {k: None for k in ("finding_id", "action_type", "title", "rationale", "confidence",
                               "effort", "estimated_monthly_savings_usd", "suggested_command")}
    for item in ({}, nulls):
        (got,) = parse(spark, json.dumps([item]))
        assert got["finding_ids"] == []
        assert (got["action_type"], got["title"], got["rationale"]) == (
            "investigate", "Investigate finding", "")
        assert (got["confidence"], got["effort"]) == ("medium", "medium")
        assert (got["estimated_monthly_savings_usd"], got["target_resource"]) == (0.0, "unknown")
        assert got["suggested_command"] is None


def test_fences_parents_and_numbers(spark):
    items = [
        {"finding_id": "f1", "title": "a" * 300, "estimated_monthly_savings_usd": "12.5"},
        {"finding_id": "gone", "title": "b", "estimated_monthly_savings_usd": 7},
        {"finding_id": "f2", "title": "c", "estimated_monthly_savings_usd": "lots"},
    ]
    text = json.dumps(items, indent=1)
    for wrapped in (text, f"```json\n{text}\n```", f"\u00a0 ```{text}```\n", f"```json```\n{text}"):
        a, b, c = parse(spark, wrapped)
        assert (len(a["title"]), a["target_resource"], a["finding_ids"]) == (300, "ws-1", ["f1"])
        assert (b["target_resource"], b["finding_ids"]) == ("unknown", ["gone"])
        assert [r["estimated_monthly_savings_usd"] for r in (a, b, c)] == [12.5, 7.0, 0.0]


@pytest.mark.parametrize("text", [
    "", "no json", '[{"title": "x"}', '[{"title": "x"}] as asked', "[{'title': 'x'}]",
    '[{"title": "x"},]', "[1, 2]", None,
])
def test_invalid_responses_give_no_rows(spark, text):
    assert parse(spark, text, '[{"title": "kept"}]')[-1]["title"] == "kept"
    assert len(parse(spark, text, '[{"title": "kept"}]')) == 1


def test_finding_ids_are_not_repeated_by_duplicate_findings(spark):
    df = spark.createDataFrame([(1, '[{"finding_id": "f1"}]')],
                               "response_id int, response_text string")
    findings = spark.createDataFrame(FINDINGS * 2, "finding_id string, affected_resource string")
    assert responses.parse_recommendations(df, findings, AS_OF).count() == 1


def python_extract(text):
    """The rule in plain form: the outer braces if there are any, else all but the fences."""
    braces = re.search(r"\{.*\}", text, re.DOTALL)
    if braces:
        body = braces[0]
    else:
        body = text.strip()
        for fence in ("```json", "```"):
            body = body.removeprefix(fence)
        body = body.removesuffix("```").strip()
    try:
        json.loads(body)
    except json.JSONDecodeError:
        return None
    return body


PIECES = st.lists(
    st.sampled_from(['{"a": 1}', '{"a": 1, "a": 2}', "] and [", ', "k": ', "{'a': 1}", '{"b": {"c": [1, "}"]}}', "{", "}", "```json\n", "```", "text",
                     "\n", " ", "\u00a0", "\u2003\t", "[]", "12", '{"a": "x\\"y"}', ","]),
    max_size=5,
).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, min_size=1, max_size=40))
def test_extract_against_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, response_text string")
    got = sorted(dicts(responses.extract_json_object(df)), key=lambda r: r["id"])
    for row, text in zip(got, texts):
        assert row["json_text"] == python_extract(text), text
        assert row["is_valid"] == (row["json_text"] is not None)
        assert (row["error_message"] is None) == row["is_valid"]


def test_usage_counts_successes_only(spark):
    df = spark.createDataFrame(
        [("r", "e", 10, 5, 15, 1.0, True), ("r", "e", 20, 5, 25, 2.01, True),
         ("r", "e", 99, 99, 99, 99.0, False), ("r", "down", 1, 1, 1, 9.0, False),
         ("r", "none", None, None, None, 0.5, True)],
        "run_id string, endpoint string, prompt_tokens int, completion_tokens int, "
        "total_tokens int, latency_seconds double, success boolean",
    )
    got = {r["endpoint"]: r for r in dicts(responses.usage_rollup(df))}
    assert got["e"] == {"run_id": "r", "endpoint": "e", "calls": 2, "failures": 1,
                        "prompt_tokens": 30, "completion_tokens": 10, "total_tokens": 40,
                        "avg_latency_seconds": 1.51}
    assert (got["down"]["calls"], got["down"]["avg_latency_seconds"]) == (0, 0.0)
    assert got["none"]["total_tokens"] == 0


# ---------------------------------------------------------------- reports


def markdown(lines):
    return one(reports.report_text(lines))["markdown"]


def findings(spark, *records):
    return spark.createDataFrame(
        list(records),
        "severity string, headline string, finding_type string, daily_cost_usd double, "
        "pct_above_baseline double, dim_value string",
    )


def test_findings_report(spark):
    high = [("HIGH", f"h{i:02}", "T", 100.0 - i, None, None) for i in range(12)]
    got = markdown(reports.findings_report(findings(
        spark, *high, (None, None, "COST_SPIKE", 5.0, 31.0, "x" * 40), ("odd", "o", "T", 1.0, 0.0, ""),
        ("LOW", "", None, 0.0, None, None),
    )))
    lines = got.split("\n")
    assert lines[0] == "## 🚨 Findings (15 total)"
    assert "### ⚠️ HIGH (12)" in lines
    assert sum(line.startswith("- **h") for line in lines) == 10
    assert "- **h09** (cost: $91.00)" in lines and "- **h10** (cost: $90.00)" not in lines
    assert "- _...and 2 more_" in lines
    assert lines[lines.index("### ℹ️ LOW (2)") + 1:] == [
        f"- **COST_SPIKE** (cost: $5.00; +31.0% vs baseline; target: {'x' * 27}...)",
        "- **Finding**",
    ]


def test_no_findings(spark):
    assert markdown(reports.findings_report(findings(spark).limit(0))) == (
        "## 🚨 Findings\n\n_No anomalies or policy violations detected._")


RECOMMENDATION = ("title string, recommendation_type string, rationale string, "
                  "confidence string, expected_savings_usd_monthly double")


def test_recommendations_report(spark):
    records = [(f"t{i:02}", "T", "why" if i else "", "LOW", 100.0 - i) for i in range(16)]
    records += [(None, "KIND", "r", None, None)]
    got = markdown(reports.recommendations_report(spark.createDataFrame(records, RECOMMENDATION)))
    assert got.startswith(
        "## 💡 Optimization Recommendations (17 total)\n\n"
        "**Estimated total monthly savings: $1,480.00**\n\n\n"
        "**1. t00**  \n_Savings:_ $100.00/mo · _Confidence:_ LOW  \n\n"
        "**2. t01**  \n_Savings:_ $99.00/mo · _Confidence:_ LOW  \nwhy\n"
    )
    assert "**15. t14**" in got and "t15" not in got
    assert got.endswith("\n_...and 2 more_")
    empty = spark.createDataFrame([], RECOMMENDATION)
    assert markdown(reports.recommendations_report(empty)) == (
        "## 💡 Recommendations\n\n_No optimization opportunities found._")


def test_titles_are_shown_or_replaced(spark):
    records = [("", "KIND", "r", "LOW", 3.0), ("x" * 300, "T", "r", "LOW", 2.0), ("", "", "r", "LOW", 1.0)]
    got = markdown(reports.recommendations_report(spark.createDataFrame(records, RECOMMENDATION)))
    assert "**1. KIND**" in got and f"**2. {'x' * 200}**" in got and "**3. Recommendation**" in got


def test_products_left_out_are_counted(spark):
    total = spark.createDataFrame([(1.0, 1.0, date(2001, 7, 13), date(2001, 7, 20), 7)],
        "total_cost_usd double, avg_daily_cost_usd double, first_date date, last_date date, days long")
    products = spark.createDataFrame([(f"p{i:02}", 50.0 - i, 1) for i in range(13)],
        "dimension_value string, total_cost_usd double, record_count long")
    users = spark.createDataFrame([], "user_email string, total_cost_usd double, avg_daily_cost_usd double")
    trend = spark.createDataFrame([], "period date, total_cost_usd double, pct_change_vs_prior double")
    got = markdown(reports.cost_summary_report(total, products, users, trend))
    assert "| p09 |" in got and "p10" not in got and got.endswith("\n_...and 3 more_")


def cost_report(spark, periods):
    total = spark.createDataFrame(
        [(1500.0, 214.29, date(2001, 7, 13), date(2001, 7, 20), 7)],
        "total_cost_usd double, avg_daily_cost_usd double, first_date date, last_date date, "
        "days long",
    )
    products = spark.createDataFrame(
        [("SQL|X", 1000.0, 1200), (None, 500.0, 3)],
        "dimension_value string, total_cost_usd double, record_count long",
    )
    users = spark.createDataFrame(
        [(f"u{i}" + "x" * 50, 100.0 - i, 1.0) for i in range(6)],
        "user_email string, total_cost_usd double, avg_daily_cost_usd double",
    )
    trend = spark.createDataFrame(
        periods, "period date, total_cost_usd double, pct_change_vs_prior double")
    return markdown(reports.cost_summary_report(total, products, users, trend))


def test_cost_summary(spark):
    first = (date(2001, 7, 9), 100.0, None)
    got = cost_report(spark, [first, (date(2001, 7, 16), 150.0, 50.0)])
    assert got.startswith(
        "## 💰 Cost Summary (last 7 days)\n\n**Total spend:** $1,500.00  \n"
        "**Avg daily:** $214.29  \n**Window:** 2001-07-13 → 2001-07-20\n\n\n"
        "### By Product\n| Product | Cost (USD) | Records |\n| --- | --- | --- |\n"
        "| SQL\\|X | $1,000.00 | 1,200 |\n| (unknown) | $500.00 | 3 |\n\n### Top 5 Users\n"
    )
    assert f"| u4{'x' * 35}... | $96.00 | $1.00 |" in got and "u5" not in got
    assert got.endswith("\n### Trend\n📈 Latest period: $150.00 (50.0% vs prior)")
    assert "📉" in cost_report(spark, [first, (date(2001, 7, 16), 50.0, -50.0)])
    assert "➡️" in cost_report(spark, [first, (date(2001, 7, 16), 100.0, 0.0)])
    assert cost_report(spark, [first, (date(2001, 7, 16), 1.0, None)]).endswith(
        "### Trend\nLatest period: $1.00")
    assert "Trend" not in cost_report(spark, [first])


def test_created_at_is_the_as_of_date(spark):
    (got,) = parse(spark, "[{}]")
    assert got["created_at"] == datetime(2001, 7, 20)
