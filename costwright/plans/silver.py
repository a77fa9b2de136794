"""Silver layer: usage records with price, cost, tags and resource ids."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.schemas import PRICE, QUANTITY

UNTAGGED = "untagged"
# The tag keys that carry cost allocation, and their column names.
TAG_COLUMNS = {
    "Environment": "tag_environment",
    "Project": "tag_project",
    "Owner": "tag_owner",
    "Team": "tag_team",
    "CostCenter": "tag_costcenter",
}

def price_intervals(prices: DataFrame, as_of: date) -> DataFrame:
    """Half-open validity intervals; an open end means the end of `as_of`."""
    now = F.lit(as_of + timedelta(days=1)).cast("timestamp")
    return prices.select(
        "sku_name",
        "cloud",
        "currency_code",
        F.col("pricing")["default"].cast(PRICE).alias("price_per_unit"),
        "price_start_time",
        F.coalesce("price_end_time", now).alias("price_end_time"),
    ).where(F.col("price_start_time") < F.col("price_end_time"))


def price_interval_join(usage: DataFrame, prices: DataFrame, as_of: date) -> DataFrame:
    """LEFT JOIN each record to the price valid when its usage started.

    Overlapping intervals give one row per match, as an ordinary join does. It is an
    equi-join on SKU and cloud with the interval as residual: Spark broadcasts a list
    that its statistics show to be small, and splits a hot SKU's records in a
    shuffled join, whose price side holds one SKU's intervals per key.
    """
    u, p = usage.alias("u"), price_intervals(prices, as_of).alias("p")
    on = (
        (F.col("u.sku_name") == F.col("p.sku_name"))
        & (F.col("u.cloud") == F.col("p.cloud"))
        & (F.col("u.usage_start_time") >= F.col("p.price_start_time"))
        & (F.col("u.usage_start_time") < F.col("p.price_end_time"))
    )
    return u.join(p, on, "left").select("u.*", "p.price_per_unit", "p.currency_code")


def price_interval_join_sliced(
    usage: DataFrame,
    prices: DataFrame,
    as_of: date,
    first: date,
    last: date,
    slice_days: int = 30,
) -> DataFrame:
    """The same rows as `price_interval_join`, for price lists with very many intervals.

    Time is cut into slices. A price is repeated for each slice that its interval touches, a
    record belongs to one slice, and the join is on SKU, cloud and slice with the interval
    as residual. So a record is compared with the prices of its slice and not with all of its
    SKU, and a hot SKU is spread over its slices. Usage must start between `first` and
    `last`, both included, which bounds the slices of an open or very long interval; a record
    outside is an error.
    """
    origin, ends = F.lit(first).cast("timestamp"), F.lit(last + timedelta(days=1)).cast("timestamp")

    def slice_of(time: Column) -> Column:
        return F.floor((F.unix_seconds(time) - F.unix_seconds(origin)) / (slice_days * 86400))

    start = F.col("usage_start_time")
    outside = F.raise_error(F.lit(f"usage before {first} or after {last}")).cast("bigint")
    within = start.isNull() | ((start >= origin) & (start < ends))
    u = usage.withColumn("_slice", F.when(within, slice_of(start)).otherwise(outside)).alias("u")

    begin = F.greatest(F.col("price_start_time"), origin)
    # the last moment that the interval holds
    end = F.least(F.col("price_end_time"), ends) - F.expr("INTERVAL 1 MICROSECOND")
    slices = F.sequence(slice_of(begin), slice_of(end))
    p = (
        price_intervals(prices, as_of)
        .where((F.col("price_start_time") < ends) & (F.col("price_end_time") > origin))
        .withColumn("_slice", F.explode(slices))
        .alias("p")
    )
    on = (
        (F.col("u.sku_name") == F.col("p.sku_name"))
        & (F.col("u.cloud") == F.col("p.cloud"))
        & (F.col("u._slice") == F.col("p._slice"))
        & (F.col("u.usage_start_time") >= F.col("p.price_start_time"))
        & (F.col("u.usage_start_time") < F.col("p.price_end_time"))
    )
    return u.join(p, on, "left").select("u.*", "p.price_per_unit", "p.currency_code").drop("_slice")


def with_cost(priced: DataFrame) -> DataFrame:
    """Quantity times price; a record without a price costs zero and stays."""
    price = F.coalesce("price_per_unit", F.lit(0).cast(PRICE))
    cost = F.col("usage_quantity").cast(QUANTITY) * price
    return priced.withColumn("estimated_cost_usd", cost)


def tag_columns() -> list[Column]:
    tags = F.col("custom_tags")
    return [
        F.coalesce(tags[key], F.lit(UNTAGGED)).alias(name) for key, name in TAG_COLUMNS.items()
    ]


def with_tags(usage: DataFrame) -> DataFrame:
    return usage.select("*", *tag_columns())


def usage_enriched(usage: DataFrame, prices: DataFrame, as_of: date) -> DataFrame:
    """The silver table. `usage` is the bronze table, already cut to its window."""
    costed = with_cost(price_interval_join(usage, prices, as_of))
    return costed.select(
        "record_id", "workspace_id", "sku_name", "cloud",
        "usage_date", "usage_month", "usage_unit", "usage_quantity", "estimated_cost_usd",
        *tag_columns(),
        "custom_tags",
        F.col("usage_metadata")["cluster_id"].alias("cluster_id"),
        F.col("usage_metadata")["warehouse_id"].alias("warehouse_id"),
        F.col("usage_metadata")["job_id"].alias("job_id"),
        F.col("usage_metadata")["notebook_id"].alias("notebook_id"),
        F.col("usage_metadata")["dlt_pipeline_id"].alias("pipeline_id"),
        F.col("identity_metadata")["run_as"].alias("run_as_user"),
        F.col("identity_metadata")["owned_by"].alias("owned_by"),
        "billing_origin_product", "usage_type", "record_type",
    )


def user_of_record() -> Column:
    return F.coalesce("run_as_user", "owned_by", "tag_owner", F.lit("unknown"))


def resource_id_of_record() -> Column:
    return F.coalesce("cluster_id", "warehouse_id", "job_id", "pipeline_id", F.lit("unknown"))


def resource_type_of_record() -> Column:
    return (
        F.when(F.col("cluster_id").isNotNull(), "cluster")
        .when(F.col("warehouse_id").isNotNull(), "warehouse")
        .when(F.col("job_id").isNotNull(), "job")
        .when(F.col("pipeline_id").isNotNull(), "pipeline")
        .otherwise("other")
    )
