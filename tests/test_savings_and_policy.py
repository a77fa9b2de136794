"""Recommendations, forecast, budgets, policy and chargeback on literal rows."""

from datetime import date, timedelta

import pytest

import rows
from costwright.operators import chargeback, forecast, optimize, policy
from rows import AS_OF, dicts, one


def test_rightsizing_one_record(spark):
    df = rows.silver(spark, {"cluster_id": "cluster-0000000001", "cost": "12.5"})
    got = one(optimize.recommend_rightsizing(df, None, AS_OF, days=14))
    assert (got["stddev_daily_cost"], got["cost_per_active_day"]) == (0.0, 12.5)
    assert got["title"] == "Right-size cluster cluster-0000"
    assert got["rationale"].startswith("Cluster cost $12.5 over 14 days.")
    assert got["expected_savings_usd_monthly"] == 8.04


def test_autoscale(spark):
    def cluster(name, costs):
        return [{"cluster_id": name, "cost": c, "ago": i} for i, c in enumerate(costs)]

    df = rows.silver(
        spark, *cluster("varies", [1, 1, 40]), *cluster("steady", [10, 10, 10]),
        *cluster("scales", [1, 1, 40]), *cluster("small", [1, 1, 40]),
        *cluster("no meta", [1, 1, 40]), *cluster("single", [40]),
    )
    meta = rows.clusters(
        spark,
        *[{"cluster_id": c, "worker_count": 4} for c in ("varies", "steady", "single")],
        {"cluster_id": "scales", "worker_count": 4, "min_autoscale_workers": 1},
        {"cluster_id": "small", "worker_count": 1},
    )
    got = one(optimize.recommend_autoscale(df, meta, AS_OF))
    assert (got["cluster_id"], got["coefficient_of_variation"]) == ("varies", 1.61)
    assert "(CV=1.61)" in got["rationale"] and "(4 workers)" in got["rationale"]


def test_photon_and_serverless(spark):
    df = rows.silver(
        spark,
        {"warehouse_id": "w1", "sku_name": "SQL_PHOTON", "usage_quantity": 9, "cost": 9},
        {"warehouse_id": "w2", "sku_name": "SQL", "usage_quantity": 5, "cost": 9},
        {"warehouse_id": "w3", "sku_name": "SQL", "usage_quantity": "4.99", "cost": 9},
        {"warehouse_id": "w4", "sku_name": "SQL", "usage_quantity": 9, "cost": 9,
         "billing_origin_product": "DLT"},
        *[{"job_id": "short", "cost": 4}] * 3,
        *[{"job_id": "long", "cost": 6}] * 3,
        *[{"job_id": "there", "sku_name": "x_Serverless", "cost": 4}] * 3,
    )
    assert one(optimize.recommend_photon(df, AS_OF))["warehouse_id"] == "w2"
    job = one(optimize.recommend_serverless(df, AS_OF))
    assert (job["job_id"], job["avg_per_run_cost"]) == ("short", 4.0)
    assert job["rationale"].startswith("Short, recurring job (avg $4.0/run).")


def test_recommendation_ids_are_unique(spark):
    df = rows.silver(
        spark,
        {"warehouse_id": "w", "sku_name": "A", "usage_quantity": 9, "cost": 9},
        {"warehouse_id": "w", "sku_name": "B", "usage_quantity": 9, "cost": 9},
        {"cluster_id": "c", "cost": 20},
    )
    got = dicts(optimize.all_recommendations({
        optimize.ENABLE_PHOTON: optimize.recommend_photon(df, AS_OF),
        optimize.RIGHT_SIZE: optimize.recommend_rightsizing(df, None, AS_OF),
    }))
    assert len({r["recommendation_id"] for r in got}) == len(got) == 3


@pytest.mark.parametrize("savings, tier, score", [
    (None, "P3", 0), (-5.0, "P3", 0), (99.99, "P3", 39.0), (100.0, "P2", 40), (499.99, "P2", 59.0),
    (500.0, "P1", 60), (1000.0, "P1", 79), (1000.01, "P0", 80.0), (10000.0, "P0", 100),
    (50000.0, "P0", 100),
])
def test_priorities(spark, savings, tier, score):
    df = spark.createDataFrame(
        [("r", savings)], "recommendation_id string, expected_savings_usd_monthly double"
    )
    got = one(chargeback.prioritize(df))
    assert (got["priority_tier"], got["priority_score"]) == (tier, score)


def month(spark, as_of, total):
    """`total` spread evenly over every date of the month so far."""
    daily = rows.daily(spark, *[((AS_OF - as_of).days + i, total / as_of.day)
                                for i in range(as_of.day)])
    return daily


@pytest.mark.parametrize("as_of, spent, budget, level, message", [
    (date(2001, 7, 24), 820, 1000.0, "HIGH", "Burning fast: 82% of budget used at 77% of month"),
    (date(2001, 7, 30), 900, 1000.0, "MEDIUM", "Approaching budget cap (90% used)"),
    (date(2001, 7, 10), 500, 1000.0, "CRITICAL", "Projected overrun: $550 above $1,000 budget"),
    (date(2001, 7, 10), 100, 1000.0, "OK", "On track (10% of budget at 32% of month)"),
    (date(2001, 7, 10), 100, 0.0, "OK", "On track (0% of budget at 32% of month)"),
])
def test_burn_rate(spark, as_of, spent, budget, level, message):
    daily = month(spark, as_of, spent)
    budgets = spark.createDataFrame([("ws", budget), (None, budget), ("idle", 10.0)],
                                    "workspace_id string, monthly_budget_usd double")
    got = {r["workspace_id"]: r for r in dicts(forecast.burn_rate(daily, budgets, as_of))}
    for scope in ("ws", None):
        assert (got[scope]["alert_level"], got[scope]["message"]) == (level, message)
        assert got[scope]["mtd_spend_usd"] == spent
    assert (got["idle"]["alert_level"], got["idle"]["mtd_spend_usd"]) == ("OK", 0.0)


def test_projection_divides_by_dates_with_data(spark):
    daily = rows.daily(spark, (0, 30), (4, 10), (19, 20), (20, 999))
    got = one(forecast.month_end_projection(daily, AS_OF))
    assert (got["mtd_total_usd"], got["avg_daily_cost_usd"]) == (60.0, 20.0)
    assert (got["days_elapsed"], got["days_remaining"], got["days_in_month"]) == (20, 11, 31)
    assert got["projected_month_end_usd"] == 280.0


def test_projection_without_data_and_in_december(spark):
    daily = rows.daily(spark, (0, 30))
    got = one(forecast.month_end_projection(daily, date(2001, 12, 31)))
    assert (got["projected_month_end_usd"], got["days_remaining"]) == (0.0, 0)
    assert dicts(forecast.month_end_projection_by_workspace(daily, date(2001, 12, 31))) == []


def test_untagged(spark):
    no = "untagged"
    df = rows.silver(
        spark,
        {"cluster_id": "a", "cost": 101, "tag_environment": no, "tag_team": no},
        {"job_id": "b", "cost": "20.01", "tag_project": no},
        {"pipeline_id": "c", "cost": 1, "tag_team": no},
        {"pipeline_id": "d", "cost": "0.999", "tag_team": no},
        {"cluster_id": "e", "cost": 500, "tag_owner": no, "tag_costcenter": no},
    )
    got = [(r["resource_id"], r["severity"], r["missing_count"], r["headline"])
           for r in dicts(policy.untagged_resources(df, AS_OF))]
    assert got == [
        ("a", "HIGH", 2, "cluster missing tags: Environment, Team"),
        ("b", "MEDIUM", 1, "job missing tags: Project"),
        ("c", "LOW", 1, "pipeline missing tags: Team"),
    ]
    assert len(dicts(policy.untagged_resources(df, AS_OF, top_n=2))) == 2


def test_lists_are_complete(spark):
    """More rows than any list used to hold."""
    df = rows.silver(spark, *[{"job_id": f"j{i}", "cost": 2, "tag_team": "untagged", "ago": a}
                              for i in range(230) for a in range(6)])
    assert policy.untagged_resources(df, AS_OF).count() == 230
    assert optimize.recommend_serverless(df, AS_OF).count() == 230
    assert optimize.recommend_serverless(df, AS_OF, top_n=3).count() == 3


def test_expensive_nodes(spark):
    df = rows.silver(spark, *[{"cluster_id": c, "cost": 3} for c in ("w", "d", "n", "none")])
    meta = rows.clusters(
        spark,
        {"cluster_id": "w", "cluster_name": "big", "worker_node_type": "Standard_M128s"},
        {"cluster_id": "d", "driver_node_type": "Standard_NC24s_v3", "worker_node_type": "small"},
        {"cluster_id": "n", "worker_node_type": "small"},
    )
    got = {r["cluster_id"]: r["headline"]
           for r in dicts(policy.expensive_node_types(df, meta, AS_OF))}
    assert got == {"w": "Cluster big uses expensive node type Standard_M128s",
                   "d": "Cluster d uses expensive node type small"}


def test_compliance(spark):
    df = rows.silver(spark, {"cost": 75}, {"cost": 25, "tag_environment": "untagged",
                                           "tag_owner": "untagged"})
    got = one(policy.tag_compliance(df, AS_OF))
    assert got["compliance_score"] == 87.5
    assert got["pct_cost_with_environment_tag"] == got["pct_cost_with_owner_tag"] == 75.0
    assert (got["untagged_cost_usd"], got["total_cost_usd"], got["message"]) == (25.0, 100.0, None)


def test_compliance_without_cost(spark):
    for df in (rows.silver(spark, {"cost": 0}), rows.silver(spark, {"cost": 1, "ago": 99})):
        got = one(policy.tag_compliance(df, AS_OF))
        assert got["compliance_score"] == 100.0
        assert got["message"] == "No cost data to evaluate"


def test_chargeback(spark):
    june, july = date(2001, 6, 30), date(2001, 7, 1)
    df = rows.silver(
        spark,
        {"date": june, "cost": 10, "cluster_id": "a"},
        *[{"date": july, "cost": c, "cluster_id": n} for n, c in
          (("a", 1), ("b", 2), ("c", 3), ("d", 4))],
        {"date": july + timedelta(days=3), "cost": 5, "job_id": "j", "tag_environment": "untagged"},
        {"date": date(2001, 4, 1), "cost": 9, "tag_team": "gap"},
        {"date": july, "cost": 9, "tag_team": "gap"},
    )
    got = {(r["team"], r["usage_month"]): r for r in dicts(chargeback.team_chargeback(df))}
    bill = got["t", "2001-07"]
    assert (bill["total_cost_usd"], bill["last_month_cost_usd"]) == (15.0, 10.0)
    assert (bill["pct_change_vs_last_month"], bill["untagged_cost_usd"]) == (50.0, 5.0)
    assert [d["resource_id"] for d in bill["top_drivers"]] == ["j", "d", "c"]
    assert got["gap", "2001-07"]["last_month_cost_usd"] is None


def test_chargeback_of_cut_months(spark):
    """No change against a month of which only a part is there, nor for such a month."""
    df = rows.silver(spark, *[{"date": date(2001, m, 20), "cost": c, "cluster_id": "a"}
                              for m, c in ((4, 1), (5, 30), (6, 60), (7, 10))])
    got = {r["usage_month"]: r["pct_change_vs_last_month"]
           for r in dicts(chargeback.team_chargeback(df, date(2001, 4, 20), AS_OF))}
    assert got == {"2001-04": None, "2001-05": None, "2001-06": 100.0, "2001-07": None}
    got = {r["usage_month"]: r["pct_change_vs_last_month"]
           for r in dicts(chargeback.team_chargeback(df, date(2001, 4, 1), date(2001, 7, 31)))}
    assert got == {"2001-04": None, "2001-05": 2900.0, "2001-06": 100.0, "2001-07": -83.3}
