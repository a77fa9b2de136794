"""Pricing, tags and rollups."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import rows
from costwright import schemas
from costwright.plans import gold, silver
from rows import AS_OF, dicts, one

START = datetime(2001, 7, 1)


def usage(spark, *records):
    """(record_id, start[, sku])"""
    data = [(r[0], r[2] if len(r) > 2 else "A", "AWS", r[1], Decimal(2)) for r in records]
    return spark.createDataFrame(
        data,
        "record_id string, sku_name string, cloud string, usage_start_time timestamp, "
        "usage_quantity decimal(18,4)",
    )


def prices(spark, *records):
    """(start, end, price[, sku])"""
    data = [
        (s, e, "acc", more[0] if more else "A", "AWS", "USD", "DBU", (Decimal(p),))
        for s, e, p, *more in records
    ]
    return spark.createDataFrame(data, schemas.LIST_PRICES)


def both_ways(u, p):
    """With the list broadcast and with both sides shuffled."""
    return [
        silver.with_cost(silver.price_interval_join(u, p.hint(hint), AS_OF))
        for hint in ("broadcast", "merge")
    ]


def test_price_boundaries(spark):
    end = datetime(2001, 7, 10)
    now = datetime(2001, 7, 21)
    u = usage(
        spark,
        ("at start", START), ("before end", end - timedelta(microseconds=1)), ("at end", end),
        ("open", START, "B"), ("last moment", now - timedelta(microseconds=1), "B"),
        ("now", now, "B"), ("no sku", START, None),
    )
    p = prices(spark, (START, end, "0.5"), (START, None, "0.25", "B"))
    for joined in both_ways(u, p):
        got = {r["record_id"]: r["estimated_cost_usd"] for r in dicts(joined)}
        assert got == {
            "at start": Decimal("1"), "before end": Decimal("1"), "at end": 0,
            "open": Decimal("0.5"), "last moment": Decimal("0.5"), "now": 0, "no sku": 0,
        }


def test_overlapping_prices_repeat_the_record(spark):
    u = usage(spark, ("r", START + timedelta(days=40)))
    p = prices(spark, (START, datetime(2002, 1, 1), "1"), (START, None, "2"),
               (datetime(2001, 1, 1), datetime(2001, 12, 1), "3"))
    u = u.withColumn("usage_start_time", F.lit(datetime(2001, 7, 15)))
    for joined in both_ways(u, p):
        assert sorted(r["price_per_unit"] for r in dicts(joined)) == [1, 2, 3]


moments = st.integers(0, 400).map(lambda d: datetime(2000, 7, 1) + timedelta(days=d, hours=d % 5))
skus = st.sampled_from(["A", "A", "A", "B", "C"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    used=st.lists(st.tuples(moments, skus), min_size=1, max_size=20),
    listed=st.lists(st.tuples(moments, st.none() | moments, skus), max_size=8),
)
def test_price_join_against_brute_force(spark, used, listed):
    now = datetime(2001, 7, 21)
    expected = []
    for i, (start, sku) in enumerate(used):
        hits = [j for j, (s, e, k) in enumerate(listed) if k == sku and s <= start < (e or now)]
        expected += [(str(i), j) for j in hits] or [(str(i), None)]
    u = usage(spark, *[(str(i), start, sku) for i, (start, sku) in enumerate(used)])
    p = prices(spark, *[(s, e, str(j), k) for j, (s, e, k) in enumerate(listed)])
    for joined in both_ways(u, p):
        got = [
            (r["record_id"], None if r["price_per_unit"] is None else int(r["price_per_unit"]))
            for r in dicts(joined)
        ]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_far_end_repeats_nothing(spark):
    """An interval that ends in the year 9999 is one row on the join's price side."""
    u = usage(spark, ("r", START))
    p = prices(spark, (START, datetime(9999, 12, 31), "1"))
    joined = silver.price_interval_join(u, p, AS_OF)
    assert joined.count() == 1
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_tags(spark):
    df = spark.createDataFrame(
        [("a", {"Environment": "prod", "Other": "x"}), ("b", None), ("c", {"Team": None})],
        "record_id string, custom_tags map<string,string>",
    )
    got = {r["record_id"]: r for r in dicts(silver.with_tags(df))}
    assert got["a"]["tag_environment"] == "prod"
    assert got["a"]["tag_project"] == "untagged"
    assert got["b"]["tag_owner"] == got["c"]["tag_team"] == "untagged"


def test_users_and_resources(spark):
    df = rows.silver(
        spark,
        {"cost": 1, "run_as_user": None, "owned_by": "owner", "cluster_id": "c", "job_id": "j"},
        {"cost": 2, "run_as_user": None, "tag_owner": "untagged", "warehouse_id": "w"},
        {"cost": 4, "pipeline_id": "p"},
        {"cost": 8},
    )
    users = {r["user_email"]: r for r in dicts(gold.cost_by_user(df))}
    assert set(users) == {"owner", "untagged", "u"}
    assert (users["owner"]["distinct_clusters"], users["owner"]["distinct_jobs"]) == (1, 1)
    found = {(r["resource_type"], r["resource_id"]): r["total_cost_usd"]
             for r in dicts(gold.cost_by_resource(df))}
    assert found == {("cluster", "c"): 1, ("warehouse", "w"): 2, ("pipeline", "p"): 4,
                     ("other", "unknown"): 8}


def test_distinct_counts_of_users_copy_no_rows(spark):
    """A record of several resources counts for each and its cost once; no row is copied for each count."""
    df = rows.silver(
        spark,
        {"cost": 1, "cluster_id": "c", "job_id": "j", "run_as_user": "u"},
        {"cost": 2, "cluster_id": "c", "warehouse_id": "w", "job_id": "k", "run_as_user": "u"},
        {"cost": 4, "run_as_user": "u"},
    )
    found = gold.cost_by_user(df)
    (r,) = dicts(found)
    counts = [r[f"distinct_{k}"] for k in ("clusters", "warehouses", "jobs")]
    assert (r["total_cost_usd"], counts) == (7, [1, 1, 2])
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_not_shuffled_for_prices_or_customers(spark):
    from workload import queries

    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")  # as for tables of any size
    try:
        df = queries.enriched(spark, "/root/testdata/sf0.001", queries.ALL_TIME)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(conf, before)
    assert plan.count("SortMergeJoin") == 4 and plan.count("BroadcastHashJoin") == 1


def test_rollups_keep_the_total(spark):
    from workload import queries

    sf_dir = "/root/testdata/sf0.001"
    bronze = queries.usage(spark, sf_dir)
    records = queries.enriched(spark, sf_dir)
    assert bronze.count() == records.count()
    total = one(records.agg(F.sum("estimated_cost_usd").alias("x")))["x"]
    for rollup in (gold.daily_cost, gold.cost_by_user, gold.cost_by_tags, gold.cost_by_resource):
        assert one(rollup(records).agg(F.sum("total_cost_usd").alias("x")))["x"] == total


def test_latest_cluster_version(spark):
    df = rows.clusters(
        spark,
        *[{"cluster_id": "hot", "cluster_name": str(i),
           "change_time": datetime(2000, 1, 1) + timedelta(hours=i)} for i in range(300)],
        {"cluster_id": "b", "cluster_name": "only", "change_time": None},
    )
    got = {r["cluster_id"]: r["cluster_name"] for r in dicts(gold.latest_clusters(df))}
    assert got == {"hot": "299", "b": "only"}
    plan = gold.latest_clusters(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hot_key_on_the_shuffled_price_join(spark):
    """A third and more of the records on one SKU give the same rows either way."""
    n = 3000
    u = spark.range(n).select(
        F.col("id").cast("string").alias("record_id"),
        F.when(F.col("id") % 2 == 0, "A").otherwise(F.concat(F.lit("S"), F.col("id") % 50))
        .alias("sku_name"),
        F.lit("AWS").alias("cloud"),
        F.timestamp_seconds(F.lit(994000000) + F.col("id") * 300).alias("usage_start_time"),
        F.lit(1).cast("decimal(18,4)").alias("usage_quantity"),
    )
    p = prices(spark, (datetime(2001, 1, 1), datetime(2001, 7, 5), "1"),
               (datetime(2001, 7, 5), None, "2"))
    first, second = both_ways(u, p)
    assert sorted(map(str, dicts(first))) == sorted(map(str, dicts(second)))
    assert first.count() == n


@pytest.mark.parametrize("bad", ["nothing", ""])
def test_unknown_dimension(spark, bad):
    from costwright.operators import anomaly, cost

    df = rows.silver(spark, {"cost": 1})
    with pytest.raises(ValueError):
        cost.cost_breakdown(df, bad, AS_OF)
    with pytest.raises(ValueError):
        anomaly.cost_spikes(df, AS_OF, dimension=bad)
    with pytest.raises(ValueError):
        cost.cost_trend(rows.daily(spark, (0, 1)), AS_OF, granularity=bad)
    with pytest.raises(ValueError):
        cost.top_spenders(df, bad, AS_OF)


# ----------------------------------------------------- long price histories


def priced_rows(joined):
    columns = ["record_id", "sku_name", "usage_start_time", "price_per_unit", "currency_code"]
    return sorted(map(str, joined.select(*columns).collect()))


def sliced(u, p, first=datetime(2001, 6, 1).date(), last=datetime(2001, 7, 31).date(), days=30):
    return silver.price_interval_join_sliced(u, p, AS_OF, first, last, days)


def test_sliced_join_has_the_rows_of_the_plain_one(spark):
    """Boundaries, overlaps, open and very long intervals, slices of every width."""
    instants = [START + timedelta(hours=h) for h in (-700, -1, 0, 1, 23, 24, 25, 240, 719, 720)]
    u = usage(
        spark, *[(str(i), t) for i, t in enumerate(instants)], ("none", None), ("other", START, "B"),
        ("no sku", START, None), ("edge", datetime(2001, 7, 31, 23, 59, 59, 999999)),
    )
    p = prices(
        spark, (START, START + timedelta(days=1), "1"), (START, None, "2"),
        (datetime(1, 1, 2), datetime(9999, 12, 31), "3"), (START, START, "4"),
        (START + timedelta(days=1), START + timedelta(hours=25), "5"),
        (datetime(2001, 6, 1), START, "6", "B"), (datetime(2002, 1, 1), datetime(2003, 1, 1), "7"),
        (datetime(2000, 1, 1), datetime(2001, 6, 1), "8"),
    )
    plain = priced_rows(silver.price_interval_join(u, p, AS_OF))
    for days in (1, 7, 30, 400):
        assert priced_rows(sliced(u, p, days=days)) == plain
    assert sliced(u, p).columns == silver.price_interval_join(u, p, AS_OF).columns


def test_usage_outside_the_slices_is_an_error(spark):
    for at in (datetime(2001, 5, 31, 23), datetime(2001, 8, 1)):
        with pytest.raises(Exception, match="usage before"):
            sliced(usage(spark, ("x", at)), prices(spark, (START, None, "1"))).count()


def test_sliced_join_with_ten_thousand_intervals(spark):
    """One hot SKU: a record meets the prices of its slice, and its records spread over slices."""
    hour = "TIMESTAMP '2001-06-01 00:00:00' + make_interval(0, 0, 0, 0, CAST({} AS INT))"
    listed = spark.range(10_000).selectExpr(
        f"{hour.format('id / 7')} AS price_start_time",
        f"{hour.format('id / 7 + 1')} AS price_end_time", "'acc' AS account_id",
        "'A' AS sku_name", "'AWS' AS cloud", "'USD' AS currency_code", "'DBU' AS usage_unit",
        "struct(CAST(id AS DECIMAL(10,4)) AS `default`) AS pricing",
    )
    used = spark.range(3000).selectExpr(
        "CAST(id AS STRING) AS record_id", "'A' AS sku_name", "'AWS' AS cloud",
        f"{hour.format('(id * 37) % 1440')} AS usage_start_time",
        "CAST(1 AS DECIMAL(18,4)) AS usage_quantity",
    )
    joined = sliced(used, listed, days=1)
    assert priced_rows(joined) == priced_rows(silver.price_interval_join(used, listed, AS_OF))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "Generate explode" in plan
