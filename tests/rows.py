"""Small literal tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from costwright import schemas

AS_OF = date(2001, 7, 20)

SILVER = (
    "record_id string, workspace_id string, sku_name string, cloud string, usage_date date, "
    "usage_month string, usage_quantity decimal(18,4), estimated_cost_usd decimal(28,8), "
    "tag_environment string, tag_project string, tag_owner string, tag_team string, "
    "tag_costcenter string, cluster_id string, warehouse_id string, job_id string, "
    "pipeline_id string, run_as_user string, owned_by string, "
    "billing_origin_product string"
)
SILVER_DEFAULTS = {
    "record_id": "r", "workspace_id": "ws", "sku_name": "SKU", "cloud": "AWS",
    "usage_quantity": 1, "tag_environment": "prod", "tag_project": "p", "tag_owner": "o",
    "tag_team": "t", "tag_costcenter": "c", "run_as_user": "u", "owned_by": None,
    "billing_origin_product": "SQL",
}


def day(ago: int) -> date:
    return AS_OF - timedelta(days=ago)


def silver(spark, *rows: dict):
    """Each row names `cost` and either `date` or `ago` (days before AS_OF)."""
    names = [part.split()[0] for part in SILVER.split(", ")]
    records = []
    for row in rows:
        values = {**SILVER_DEFAULTS, **row}
        values["usage_date"] = row.get("date") or day(row.get("ago", 0))
        values["usage_month"] = values["usage_date"].strftime("%Y-%m")
        values["estimated_cost_usd"] = Decimal(str(row.get("cost", 0)))
        values["usage_quantity"] = Decimal(str(values["usage_quantity"]))
        records.append(tuple(values.get(n) for n in names))
    return spark.createDataFrame(records, SILVER)


def clusters(spark, *rows: dict):
    records = []
    for row in rows:
        values = {"change_time": datetime(2001, 1, 1), **row}
        records.append(tuple(values.get(n) for n in schemas.CLUSTERS.names))
    return spark.createDataFrame(records, schemas.CLUSTERS)


def daily(spark, *rows):
    """(days ago, cost) or (days ago, cost, workspace[, sku]) of the daily rollup."""
    records = []
    for row in rows:
        ago, cost, workspace, sku = (*row, *("ws", "SKU")[len(row) - 2:])
        records.append((day(ago), workspace, sku, "SQL", Decimal(1), Decimal(str(cost)), 1))
    return spark.createDataFrame(
        records,
        "usage_date date, workspace_id string, sku_name string, billing_origin_product string, "
        "total_usage decimal(28,4), total_cost_usd decimal(38,8), record_count bigint",
    )


def dicts(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]


def one(df) -> dict:
    (row,) = dicts(df)
    return row
