"""Cost questions and findings on literal rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import rows
from costwright.operators import anomaly, cost, run_metrics
from rows import AS_OF, day, dicts, one


def test_total_divides_by_days_over_one_more_date(spark):
    daily = rows.daily(spark, (0, 10), (7, 4), (8, 100))
    got = one(cost.total_cost(daily, AS_OF, days=7))
    assert got["total_cost_usd"] == 14.0
    assert got["avg_daily_cost_usd"] == 2.0
    assert (got["first_date"], got["last_date"], got["days_with_data"]) == (day(7), day(0), 2)


def test_total_without_data(spark):
    got = one(cost.total_cost(rows.daily(spark, (30, 1)), AS_OF, days=7))
    assert got["total_cost_usd"] is None and got["days_with_data"] == 0


def test_total_of_one_workspace(spark):
    daily = rows.daily(spark, (0, 10, "a"), (0, 3, "b"))
    assert one(cost.total_cost(daily, AS_OF, workspace_id="b"))["total_cost_usd"] == 3.0
    both = {r["workspace_id"]: r["total_cost_usd"]
            for r in dicts(cost.total_cost_by_workspace(daily, AS_OF))}
    assert both == {"a": 10.0, "b": 3.0}


def test_breakdown_drops_zero_not_tiny(spark):
    df = rows.silver(spark, {"sku_name": "zero", "cost": 0}, {"sku_name": "tiny", "cost": "0.001"},
                     {"sku_name": "big", "cost": 5})
    got = dicts(cost.cost_breakdown(df, "sku", AS_OF))
    assert [(r["dimension_value"], r["total_cost_usd"]) for r in got] == [("big", 5.0), ("tiny", 0)]
    assert len(dicts(cost.cost_breakdown(df, "sku", AS_OF, top_n=1))) == 1


def test_top_spenders_drop_what_rounds_to_zero(spark):
    from costwright.plans import gold

    df = rows.silver(
        spark,
        {"run_as_user": "a", "cost": "0.004", "cluster_id": "x"},
        {"run_as_user": "b", "cost": 6, "workspace_id": "1", "job_id": "j"},
        {"run_as_user": "b", "cost": 2, "workspace_id": "2", "job_id": "j"},
        {"run_as_user": "c", "cost": 50},
    )
    users = dicts(cost.top_spenders(gold.cost_by_user(df), "user", AS_OF))
    assert [(u["user_email"], u["total_cost_usd"], u["avg_daily_cost_usd"], u["job_uses"])
            for u in users] == [("c", 50.0, 50.0, 0), ("b", 8.0, 4.0, 2)]
    resources = dicts(cost.top_spenders(gold.cost_by_resource(df), "resource", AS_OF))
    assert [(r["resource_id"], r["total_cost_usd"]) for r in resources] == [("j", 8.0)]


def test_trend(spark):
    got = dicts(cost.cost_trend(rows.daily(spark, (2, 0), (1, 10), (0, 15)), AS_OF))
    assert [r["pct_change_vs_prior"] for r in got] == [None, None, 50.0]


def test_trend_weeks_start_on_monday(spark):
    got = dicts(cost.cost_trend(rows.daily(spark, (0, 1), (4, 1), (5, 1)), AS_OF, 30, "week"))
    assert [r["period"] for r in got] == [date(2001, 7, 9), date(2001, 7, 16)]


def spike_input(spark, costs, **more):
    ago = range(len(costs) - 1, -1, -1)
    return rows.silver(spark, *[{"ago": a, "cost": c, **more} for a, c in zip(ago, costs)])


@pytest.mark.parametrize("costs, pct", [
    ([10, 10, 10, "13.01"], [30.1]),
    ([10, 10, "13.01"], []),
    ([0, 0, 0, 0, 9], []),
    ([10, 10, 10, "4.99"], []),
    ([10, 10, 10, 13], [30.0]),
])
def test_spike(spark, costs, pct):
    got = dicts(anomaly.cost_spikes(spike_input(spark, costs), AS_OF))
    assert [r["pct_above_baseline"] for r in got] == pct


def test_baseline_is_seven_rows_not_seven_days(spark):
    df = rows.silver(spark, *[{"ago": a, "cost": c} for a, c in
                              [(28, 100), (26, 1), (24, 1), (22, 1), (20, 1), (18, 1), (16, 1),
                               (14, 1), (0, 10)]])
    (spike,) = dicts(anomaly.cost_spikes(df, AS_OF, lookback_days=30))
    assert (spike["baseline_avg_usd"], spike["baseline_days"]) == (1.0, 7)


def test_spike_of_resources_ignores_pipelines(spark):
    df = spike_input(spark, [10, 10, 10, 20], pipeline_id="p")
    (spike,) = dicts(anomaly.cost_spikes(df, AS_OF, dimension="resource"))
    assert spike["dim_value"] == "unknown"


@pytest.mark.parametrize("delta, severity", [
    (49.99, "LOW"), (50.0, "MEDIUM"), (500.0, "HIGH"), (5000.0, "CRITICAL"),
])
def test_severity_bands(spark, delta, severity):
    df = spark.range(1).select(anomaly.spike_severity(F.lit(delta)).alias("s"))
    assert one(df)["s"] == severity


def test_sustained_spikes(spark):
    def spike(value, ago, delta):
        return ("workspace", value, day(ago), delta, 40.0)

    found = spark.createDataFrame(
        [spike("a", 9, 10.0), spike("a", 8, 10.0), spike("a", 6, 10.0), spike("a", 3, 300.0),
         spike("a", 2, 300.0), spike("b", 1, 9.0)],
        "dimension string, dim_value string, usage_date date, delta_usd double, "
        "pct_above_baseline double",
    )
    got = sorted(
        (r["first_date"], r["spike_days"], r["total_delta_usd"], r["severity"])
        for r in dicts(anomaly.sustained_spikes(found))
    )
    assert got == [(day(9), 2, 20.0, "MEDIUM"), (day(3), 2, 600.0, "HIGH")]


def test_idle_clusters(spark):
    ids = ["null", "zero", "long", "short", "job", "no meta", "cheap"]
    df = rows.silver(spark, *[{"cluster_id": c, "cost": 1 if c == "cheap" else 101} for c in ids])
    meta = rows.clusters(
        spark,
        {"cluster_id": "null", "cluster_source": "UI"},
        {"cluster_id": "zero", "auto_termination_minutes": 0},
        {"cluster_id": "long", "auto_termination_minutes": 121, "cluster_source": "API"},
        {"cluster_id": "short", "auto_termination_minutes": 120},
        {"cluster_id": "job", "cluster_source": "JOB"},
    )
    got = {r["cluster_id"]: r["reason"] for r in dicts(anomaly.idle_clusters(df, meta, AS_OF))}
    assert got == {
        "null": "Auto-termination disabled", "zero": "Auto-termination disabled",
        "long": "Auto-termination too long (121 min)", "no meta": "Auto-termination disabled",
    }


def test_idle_by_cost_alone(spark):
    df = rows.silver(spark, {"cluster_id": "a", "cost": "5.004"}, {"cluster_id": "b", "cost": 101},
                     {"warehouse_id": "w", "cost": "5.01"})
    clusters = {r["cluster_id"]: r["severity"]
                for r in dicts(anomaly.idle_clusters_no_metadata(df, AS_OF))}
    assert clusters == {"b": "HIGH"}
    assert [r["warehouse_id"] for r in dicts(anomaly.idle_warehouses(df, AS_OF))] == ["w"]


def test_zscore_needs_seven_dates_and_spread(spark):
    six = rows.daily(spark, *[(a, 10) for a in range(5)], (5, 1000))
    assert dicts(run_metrics.daily_zscore_anomalies(six, AS_OF, zscore=1.0)) == []
    constant = rows.daily(spark, *[(a, 10) for a in range(20)])
    assert dicts(run_metrics.daily_zscore_anomalies(constant, AS_OF)) == []


def test_zscore_text(spark):
    daily = rows.daily(spark, *[(a, 10) for a in range(1, 20)], (0, 110))
    (found,) = dicts(run_metrics.daily_zscore_anomalies(daily, AS_OF))
    assert found["title"] == "Daily cost spike on 2001-07-20"
    assert found["description"] == (
        "Daily cost was $110.00, 4.2 std devs from the 30-day mean of $15.00."
    )
    assert found["severity"] == "high"


def test_metrics(spark):
    daily = rows.daily(spark, *[(a, 2, "ws", "A") for a in range(7)],
                       *[(a, 1, "ws", "B") for a in range(7, 14)])
    got = one(run_metrics.summary_metrics(daily, AS_OF))
    assert got == {
        "total_cost_usd": 21.0, "avg_daily_cost_usd": 1.5, "last_7d_cost_usd": 14.0,
        "prior_7d_cost_usd": 7.0, "wow_change_pct": 100.0, "top_sku_share_pct": 66.67,
        "lookback_days": 14,
    }
    metrics = run_metrics.run_metrics(daily, AS_OF)
    (concentration,) = dicts(run_metrics.sku_concentration(metrics, AS_OF))
    assert concentration["description"].startswith("66.7% of total spend")
    (jump,) = dicts(run_metrics.wow_jump(metrics, AS_OF))
    assert (jump["severity"], jump["title"]) == ("high", "Spend up 100.0% week-over-week")
    found = run_metrics.all_findings(
        run_metrics.daily_zscore_anomalies(daily, AS_OF, zscore=0.5, min_cost_usd=1),
        run_metrics.sku_concentration(metrics, AS_OF),
        run_metrics.wow_jump(metrics, AS_OF),
    )
    assert {r["severity"] for r in dicts(found)} == {"MEDIUM", "HIGH"}


def test_metrics_below_fourteen_dates_have_no_prior(spark):
    got = one(run_metrics.summary_metrics(rows.daily(spark, *[(a, 2) for a in range(13)]), AS_OF))
    assert (got["last_7d_cost_usd"], got["prior_7d_cost_usd"], got["wow_change_pct"]) == (14, 0, 0)


def test_metrics_without_data(spark):
    got = one(run_metrics.summary_metrics(rows.daily(spark, (90, 1)), AS_OF))
    assert got.pop("total_cost_usd") == 0.0
    assert set(got.values()) == {None}


def test_top_sku_tie_goes_to_the_first_name(spark):
    metrics = run_metrics.run_metrics(
        rows.daily(spark, (0, 5, "ws", "B"), (0, 5, "ws", "A"), (1, 1, "ws", "C")), AS_OF
    )
    assert one(metrics)["top_sku"] == "A"
