"""Sources, sinks, upserts, the audit trail and the scheduled ingest."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import rows
from costwright import schemas
from costwright.operators import optimize, responses, run_metrics
from costwright.sources import bronze, tables
from costwright.streaming import ingest
from rows import AS_OF, dicts, one

SF_DIR = "/root/testdata/sf0.001"


def test_missing_source_is_an_empty_table_with_all_columns(spark, tmp_path):
    for source in ("no_such_schema.t", "no_such_table", str(tmp_path / "none")):
        got = bronze.load_or_empty(spark, source, schemas.CLUSTERS)
        assert got.schema == schemas.CLUSTERS and got.count() == 0
    there = str(tmp_path / "there")
    spark.range(3).write.parquet(there)
    assert bronze.load_or_empty(spark, there, schemas.CLUSTERS).count() == 3


def test_usage_window_and_positive_quantity(spark):
    from workload import fixtures

    source = fixtures.usage_source(spark, SF_DIR)
    got = bronze.billing_usage(source, AS_OF, 30)
    span = one(got.agg(F.min("usage_date").alias("a"), F.max("usage_date").alias("b"),
                       F.min("usage_quantity").alias("q")))
    assert span["a"] >= AS_OF - timedelta(days=30) and span["b"] <= AS_OF and span["q"] > 0
    assert got.columns[-1] == "usage_month"
    none = source.withColumn("usage_quantity", F.lit(0).cast("decimal(18,4)"))
    assert bronze.billing_usage(none, AS_OF, 30).count() == 0


def test_window_reaches_the_scan(spark):
    from workload import queries

    plan = queries.usage(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_job_runs_window(spark):
    row = dict.fromkeys(schemas.JOB_RUNS.names)
    starts = [datetime(2001, 7, 13), datetime(2001, 7, 12, 23), datetime(2001, 7, 20, 23),
              datetime(2001, 7, 21)]
    df = spark.createDataFrame([{**row, "period_start_time": s} for s in starts], schemas.JOB_RUNS)
    got = {r["period_start_time"] for r in dicts(bronze.job_runs(df, AS_OF, 7))}
    assert got == {starts[0], starts[2]}


# ---------------------------------------------------------------- writing


def test_write_modes_and_new_columns(spark):
    name = "write_modes"
    tables.write_table(spark.range(2).withColumn("p", F.lit("a")), name, partition_by=["p"])
    wider = spark.range(2, 3).select(F.lit(1.5).alias("extra"), "id", F.lit("b").alias("p"))
    tables.write_table(wider, name, mode="append")
    tables.write_table(spark.range(3, 4), name, mode="append")
    assert {(r["id"], r["p"], r["extra"]) for r in dicts(spark.table(name))} == {
        (0, "a", None), (1, "a", None), (2, "b", 1.5), (3, None, None)}
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.write_table(spark.range(1), name, mode="errorifexists")
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), name, mode="upsert")
    tables.write_table(spark.range(5), name)
    assert spark.table(name).count() == 5


# ----------------------------------------------------------------- upsert

TARGET = "k int, a string, b string"


def merged(target, source, **options):
    return sorted(map(str, (tuple(r) for r in
                            tables.merge_upsert(target, source, ["k"], **options).collect())))


def test_merge(spark):
    target = spark.createDataFrame([(1, "x", "x"), (2, "y", "y"), (None, "n", "n")], TARGET)
    source = spark.createDataFrame([(2, "Y", None), (3, "z", "z"), (None, "m", "m")], TARGET)
    everything = [(1, "x", "x"), (2, "Y", None), (3, "z", "z"), (None, "m", "m"), (None, "n", "n")]
    assert merged(target, source) == sorted(map(str, everything))
    only_a = [(1, "x", "x"), (2, "Y", "y"), (3, "z", "z"), (None, "m", "m"), (None, "n", "n")]
    assert merged(target, source, update_columns=["a"]) == sorted(map(str, only_a))
    narrow = [(1, "x", "x"), (2, "Y", "y"), (3, "z", None), (None, "m", None), (None, "n", "n")]
    assert merged(target, source.drop("b")) == sorted(map(str, narrow))
    with pytest.raises(ValueError):
        tables.merge_upsert(target, source.withColumn("new", F.lit(1)), ["k"])


def test_merge_refuses_two_rows_for_one(spark):
    target = spark.createDataFrame([(1, "x", "x")], TARGET)
    twice = spark.createDataFrame([(1, "a", "a"), (1, "b", "b")], TARGET)
    for read in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("k").collect()):
        with pytest.raises(Exception, match="several source rows"):
            read(tables.merge_upsert(target, twice, ["k"]))
    new_key = spark.createDataFrame([(5, "a", "a"), (5, "b", "b")], TARGET)
    assert tables.merge_upsert(target, new_key, ["k"]).count() == 3


keys = st.none() | st.integers(0, 5)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(keys, max_size=8), st.sets(keys, max_size=6))
def test_merge_against_brute_force(spark, target_keys, source_keys):
    target = spark.createDataFrame([(k, f"t{i}", "b") for i, k in enumerate(target_keys)], TARGET)
    source = spark.createDataFrame([(k, f"s{k}", "c") for k in source_keys], TARGET)
    expected = [(k, f"s{k}", "c") if k is not None and k in source_keys else (k, f"t{i}", "b")
                for i, k in enumerate(target_keys)]
    expected += [(k, f"s{k}", "c") for k in source_keys if k is None or k not in target_keys]
    assert merged(target, source) == sorted(map(str, expected))


def test_merge_into_table(spark):
    name, columns = "merge_into", "k int, a string, day string"
    first = [(1, "x", "d1"), (2, "y", "d1"), (1, "z", "d2"), (4, "n", None)]
    tables.write_table(spark.createDataFrame(first, columns), name, partition_by=["day"])
    before = {f for f in spark.table(name).inputFiles() if "day=d2" in f}
    tables.merge_into_table(
        spark.createDataFrame([(2, "Y", "d1"), (3, "new", "d3")], columns), name, ["k", "day"])
    assert {tuple(r) for r in spark.table(name).select("k", "a", "day").collect()} == {
        (1, "x", "d1"), (2, "Y", "d1"), (1, "z", "d2"), (4, "n", None), (3, "new", "d3")}
    assert before and before == {f for f in spark.table(name).inputFiles() if "day=d2" in f}
    with pytest.raises(ValueError, match="partitioned"):
        tables.merge_into_table(spark.createDataFrame([(1, "x", "d1")], columns), name, ["k"])


# ------------------------------------------------------------ audit trail

START, END = datetime(2001, 7, 20, 6), datetime(2001, 7, 20, 6, 2)


def findings(spark):
    daily = rows.daily(spark, *[(a, 10) for a in range(1, 20)], (0, 110))
    metrics = run_metrics.run_metrics(daily, AS_OF)
    found = run_metrics.all_findings(
        run_metrics.daily_zscore_anomalies(daily, AS_OF),
        run_metrics.sku_concentration(metrics, AS_OF),
        run_metrics.wow_jump(metrics, AS_OF),
    )
    return metrics.drop("top_sku", "top_sku_cost_usd"), found


def test_audit_schemas_have_the_agreed_columns():
    widths = {name: len(schema) for name, schema in schemas.AUDIT.items()}
    assert widths == {"runs": 16, "findings": 17, "recommendations": 20, "actions": 12,
                      "llm_calls": 11}


def test_audit_trail(spark):
    database = "audit_trail"
    assert tables.create_audit_tables(spark, database) == 5
    assert tables.create_audit_tables(spark, database) == 5
    metrics, found = findings(spark)
    parsed = responses.parse_recommendations(
        spark.createDataFrame([(1, '[{"finding_id": "f", "title": "Do"}]')],
                              "response_id int, response_text string"),
        spark.createDataFrame([("f", "ws")], "finding_id string, affected_resource string"),
        AS_OF,
    )
    finding_rows = tables.findings_rows(found, "run")
    recommendation_rows = tables.recommendations_rows(parsed, "run", END)
    run = tables.run_row(found, parsed, metrics, "run", START, END, config={"lookback_days": 30})

    tables.append_audit(finding_rows, database, "findings", dry_run=True)
    assert spark.table(f"{database}.findings").count() == 0

    for _ in range(2):
        tables.append_audit(finding_rows, database, "findings")
    tables.append_audit(recommendation_rows, database, "recommendations")
    tables.append_audit(run, database, "runs")

    stored = dicts(spark.table(f"{database}.findings"))
    assert len(stored) == 2 * found.count() == 6
    assert {r["status"] for r in stored} == {"OPEN"}
    assert {str(r["detected_date"]) for r in stored} == {"2001-07-20"}
    evidence = [json.loads(r["raw_data"]) for r in stored if r["finding_type"] == "anomaly"]
    assert set(evidence[0]) == {"zscore", "mean", "std"}

    stored = one(spark.table(f"{database}.recommendations"))
    assert (stored["status"], stored["confidence"], stored["title"]) == ("PROPOSED", "MEDIUM", "Do")
    assert json.loads(stored["implementation_steps"]) == {
        "suggested_command": None, "finding_ids": ["f"]}

    stored = one(spark.table(f"{database}.runs"))
    assert (stored["findings_count"], stored["recommendations_count"]) == (3, 1)
    assert (stored["status"], stored["duration_seconds"], stored["llm_calls"]) == (
        "SUCCESS", 120.0, 0)
    snapshot = json.loads(stored["config_snapshot"])
    assert snapshot["config"] == {"lookback_days": 30}
    assert snapshot["summary_metrics"]["total_cost_usd"] == 300.0
    assert snapshot["node_timings_ms"] == {}


def test_nothing_is_written_when_there_is_nothing(spark):
    database = "audit_empty"
    tables.create_audit_tables(spark, database)
    _, found = findings(spark)
    tables.append_audit(tables.findings_rows(found.limit(0), "run"), database, "findings")
    assert spark.table(f"{database}.findings").count() == 0


def test_savings_recommendations_fit_the_audit_table(spark):
    df = rows.silver(spark, {"cluster_id": "c", "cost": 20})
    found = optimize.all_recommendations(
        {optimize.RIGHT_SIZE: optimize.recommend_rightsizing(df, None, AS_OF)})
    got = one(tables.recommendations_rows(found, "run", END))
    assert (got["recommendation_type"], got["resource_id"], got["run_id"]) == (
        "RIGHT_SIZE", "c", "run")


# ------------------------------------------------------- scheduled ingest


def test_ingest_takes_each_file_once_and_agrees_with_the_batch(spark, tmp_path):
    from workload import queries

    bronze_usage = queries.usage(spark, SF_DIR).drop("usage_month")
    landing, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    prices = queries.prices(spark, SF_DIR).cache()

    def run():
        stream = spark.readStream.schema(bronze_usage.schema).parquet(landing)
        ingest.enrich_new_usage(stream, prices, AS_OF, target, checkpoint).awaitTermination()

    even = F.crc32("record_id") % 2 == 0
    bronze_usage.where(even).write.parquet(landing)
    run()
    bronze_usage.where(~even).write.mode("append").parquet(landing)
    run()
    run()
    columns = [c for c in queries.SILVER_COLUMNS if c != "custom_tags"]
    streamed = spark.read.parquet(target).withColumn(
        "usage_month", F.date_format("usage_date", "yyyy-MM")).select(*columns)
    batch = queries.enriched(spark, SF_DIR).select(*columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


# ------------------------------------------------------------ full refresh


def test_refresh_writes_every_layer(spark, tmp_path):
    from costwright.sources import ingest as full
    from workload import fixtures, queries

    sources = {n: str(tmp_path / n) for n in ("usage", "prices", "clusters", "job_runs")}
    fixtures.usage_source(spark, SF_DIR).write.parquet(sources["usage"])
    fixtures.price_source(spark, SF_DIR).write.parquet(sources["prices"])
    fixtures.cluster_source(spark, SF_DIR).write.parquet(sources["clusters"])
    for _ in range(2):
        counts = {r["table_name"]: r["row_count"] for r in dicts(
            full.refresh(spark, **sources, as_of=AS_OF, days=90, prefix="costs_"))}
    assert counts["costs_bronze.job_runs"] == 0
    assert counts["costs_bronze.billing_usage"] == counts["costs_silver.usage_enriched"] > 0
    expected = {r["table_name"]: r["row_count"]
                for r in dicts(queries.ingest_row_counts(spark, SF_DIR))}
    assert {k.removeprefix("costs_"): v for k, v in counts.items() if "job_runs" not in k} == expected

    columns = ["usage_date", "workspace_id", "user_email", "total_cost_usd", "distinct_jobs"]
    from costwright.plans import gold

    stored = spark.table("costs_gold.cost_by_user").select(*columns)
    direct = gold.cost_by_user(queries.enriched(spark, SF_DIR)).select(*columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, direct.collect()))


def test_refresh_needs_usage(spark, tmp_path):
    from costwright.sources import ingest as full

    missing = str(tmp_path / "missing")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        full.refresh(spark, missing, missing, missing, missing, AS_OF)


# ------------------------------------------------- stored runs and defaults


def test_a_run_is_stored_once_however_often_it_is_written(spark):
    database = "stored_runs"
    tables.create_audit_tables(spark, database)
    _, found = findings(spark)
    name = f"{database}.findings"

    def stored(run, days=0, n=9):
        rows = tables.findings_rows(found.limit(n), run)
        return rows.withColumn("detected_at", F.col("detected_at") + F.make_dt_interval(F.lit(days)))

    def counts():
        found = spark.table(name).groupBy("run_id", "detected_date").count()
        return {(r["run_id"], r["detected_date"].day): r["count"] for r in dicts(found)}

    for run, days in (("a", 0), ("b", 0), ("c", 2), ("a", 0)):
        tables.replace_run(stored(run, days), database, "findings", run)
    assert counts() == {("a", 20): 3, ("b", 20): 3, ("c", 22): 3}
    untouched = {f for f in spark.table(name).inputFiles() if "2001-07-22" in f}
    # fewer rows, on another day; then none at all
    tables.replace_run(stored("a", 1, 2), database, "findings", "a")
    assert counts() == {("a", 21): 2, ("b", 20): 3, ("c", 22): 3}
    tables.replace_run(stored("a", 0, 0), database, "findings", "a")
    assert counts() == {("b", 20): 3, ("c", 22): 3}
    assert untouched and untouched <= set(spark.table(name).inputFiles())
    with pytest.raises(Exception, match="another run"):
        tables.replace_run(stored("d"), database, "findings", "a")
    assert {t.name for t in spark.catalog.listTables(database)} >= {"findings", "runs"}


def test_partial_rows_take_defaults_and_required_values_are_enforced(spark):
    database = "partial_rows"
    tables.create_audit_tables(spark, database)
    at = F.lit(START)
    one_row = spark.range(1).select(F.lit("r").alias("run_id"), at.alias("started_at"))
    tables.insert_partial(one_row, database, "runs")
    stored = one(spark.table(f"{database}.runs"))
    assert (stored["run_id"], stored["findings_count"], stored["llm_tokens"]) == ("r", 0, 0)
    assert stored["status"] is None
    with pytest.raises(ValueError, match="started_at"):
        tables.insert_partial(one_row.drop("started_at"), database, "runs")
    no_id = one_row.withColumn("run_id", F.lit(None).cast("string"))
    for write in (tables.insert_partial, tables.append_audit):
        with pytest.raises(Exception, match="run_id of runs is required"):
            write(no_id, database, "runs")
    assert spark.table(f"{database}.runs").count() == 1


def test_upsert_evaluates_both_sides_once(spark):
    target = spark.createDataFrame([(1, "x", "x")], TARGET)
    spark.createDataFrame([(2, "y", "y")], TARGET).write.mode("overwrite").saveAsTable("upsert_from")
    target.write.mode("overwrite").saveAsTable("upsert_into")
    merged_rows = tables.merge_upsert(spark.table("upsert_into"), spark.table("upsert_from"), ["k"])
    plan = merged_rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upsert_into") <= 1 and plan.count("Relation ") == 2


# ------------------------------------------------------- layers kept up to date


def billing(spark, *records):
    """Bronze usage: (id, days before AS_OF, quantity)."""
    columns = "id string, ago int, usage_quantity decimal(18,4)"
    rows_in = spark.createDataFrame([(i, a, q) for i, a, q in records], columns)
    day = F.date_sub(F.lit(AS_OF), F.col("ago"))
    known = {
        "record_id": F.col("id"), "workspace_id": F.lit("ws"), "sku_name": F.lit("s"),
        "cloud": F.lit("AWS"), "usage_start_time": day.cast("timestamp"), "usage_date": day,
        "usage_quantity": F.col("usage_quantity"),
        "usage_metadata": F.struct(*[
            F.lit("job" if n == "job_id" else None).cast("string").alias(n)
            for n in schemas.USAGE_METADATA.names]),
    }
    return rows_in.select(*[
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.BILLING_USAGE.fields])


def price(spark):
    row = (datetime(2000, 1, 1), None, None, "s", "AWS", "USD", "DBU", (Decimal("2.0000"),))
    return spark.createDataFrame([row], schemas.LIST_PRICES)


def test_late_records_touch_their_dates_only(spark):
    from costwright.sources import ingest as full

    empty = [spark.createDataFrame([], s) for s in (schemas.CLUSTERS, schemas.JOB_RUNS)]
    first = [("a", 1, Decimal(1)), ("b", 2, Decimal(2)), ("c", 3, Decimal(3))]
    full.refresh(spark, billing(spark, *first), price(spark), *empty, AS_OF, 7, "late_")
    layers = full.Layers(spark, "late_")
    old = str(AS_OF - timedelta(days=3))

    def files():
        return {f for n in ("late_silver.usage_enriched", "late_gold.daily_cost")
                for f in spark.table(n).inputFiles() if old in f}

    before = files()
    # one new record, one that replaces a known one, one for a date without records
    late = [("d", 1, Decimal(10)), ("b", 2, Decimal(5)), ("e", 5, Decimal(7))]
    for _ in range(2):
        dates = full.apply_late(
            layers, bronze.billing_usage(billing(spark, *late), AS_OF, 7), AS_OF)
    assert dates == [AS_OF - timedelta(days=n) for n in (5, 2, 1)]
    assert full.apply_late(layers, bronze.billing_usage(billing(spark), AS_OF, 7), AS_OF) == []
    assert before and before == files()

    everything = [first[0], first[2], *late]
    full.refresh(spark, billing(spark, *everything), price(spark), *empty, AS_OF, 7, "whole_")
    whole = full.Layers(spark, "whole_")
    for name in full.ROLLUPS:
        got, expected = (sorted(map(str, x.rollup(name, AS_OF, 7).collect())) for x in (layers, whole))
        assert got == expected and len(got) == 4
    got, expected = (sorted(map(str, x.usage_enriched(AS_OF, 7).collect())) for x in (layers, whole))
    assert got == expected


def test_windows_read_their_partitions_and_reports_read_no_source(spark):
    from workload import layers, queries

    written = layers.stored(spark, SF_DIR)
    assert layers.stored(spark, SF_DIR) is written
    plan = written.rollup("daily_cost", AS_OF, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in plan
    for query in (queries.report_text, queries.findings_report, queries.prioritize_recommendations):
        plan = query(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "l_shipdate" not in plan
    assert plan.count("price_start_time") == 0
