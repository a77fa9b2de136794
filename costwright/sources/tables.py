"""Result tables: writing, upserts and the audit trail."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costwright import schemas

MODES = ("overwrite", "append", "errorifexists")


def create_audit_tables(spark: SparkSession, database: str) -> int:
    """Create the schema and its audit tables where missing; returns how many exist.

    All are partitioned by the day of their time.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {database}")
    for name, schema in schemas.AUDIT.items():
        defaults = schemas.AUDIT_DEFAULTS[name]
        columns = []
        for field in schema.fields:
            text = f"{field.name} {field.dataType.simpleString()}"
            if not field.nullable:
                text += " NOT NULL"
            if field.name in defaults:
                value = defaults[field.name]
                text += f" DEFAULT {value!r}"
            columns.append(text)
        columns.append(f"{_day_column(name)} date")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({', '.join(columns)}) "
            f"USING parquet PARTITIONED BY ({_day_column(name)})"
        )
    present = {t.name for t in spark.catalog.listTables(database)}
    missing = set(schemas.AUDIT) - present
    if missing:
        raise RuntimeError(f"audit tables not created in {database}: {sorted(missing)}")
    return len(present & set(schemas.AUDIT))


def _day_column(audit_table: str) -> str:
    return schemas.AUDIT_TIME_COLUMN[audit_table].replace("_at", "_date")


def write_table(
    df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """Write a parquet table. An append may bring new columns or leave some out."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; use one of {MODES}")
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(name):
        existing = spark.table(name).columns
        new = [f for f in df.schema.fields if f.name not in existing]
        if new:
            added = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new)
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({added})")
        columns = [
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in spark.table(name).schema.fields
        ]
        df.select(*columns).write.insertInto(name)
        return
    writer = df.write.format("parquet").mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update_columns: list[str] | None = None,
) -> DataFrame:
    """`target` after an upsert from `source`.

    A target row with the same keys takes the source's `update_columns` (all but the
    keys if not given) and keeps its other columns. Source rows without a match are
    inserted; a NULL key matches nothing. Two source rows for one target row are an
    error, raised while the result is read.

    One full outer join, so that both sides are evaluated once. Rows with a NULL key are
    spread over the tasks, as they meet nobody.
    """
    if update_columns is None:
        update_columns = [c for c in source.columns if c not in keys]
    unknown = set(source.columns) - set(target.columns)
    if unknown:
        raise ValueError(f"source columns missing from the target: {sorted(unknown)}")

    def sided(df, side, first_row):
        unmatched = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        place = F.when(unmatched, first_row + F.monotonically_increasing_id()).otherwise(0)
        named = [F.col(c).alias(f"{side}_{c}") for c in df.columns]
        return df.select(*named, place.alias(f"{side}__place"), F.lit(True).alias(f"{side}__row"))

    old, new = sided(target, "old", F.lit(1)), sided(source, "new", F.lit(1 << 60))
    joined_on = [*keys, "_place"]
    same_key = Window.partitionBy(*[f"new_{k}" for k in joined_on])
    new = new.withColumn("new__rows", F.count("*").over(same_key))
    condition = [F.col(f"old_{k}") == F.col(f"new_{k}") for k in joined_on]
    # A filter above the join, as an unread column would be pruned with its check.
    error = F.raise_error(F.lit("several source rows match one target row")).cast("boolean")
    twice = F.col("old__row") & (F.col("new__rows") > 1)
    rows = old.join(new, condition, "full").where(F.when(twice, error).otherwise(F.lit(True)))

    def value(c):
        if c not in source.columns:
            return F.col(f"old_{c}")
        from_source = F.col("new__row").isNotNull() if c in update_columns else F.col("old__row").isNull()
        return F.when(from_source, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))

    return rows.select(*[value(c).alias(c) for c in target.columns])


def replace_partitions(df: DataFrame, name: str) -> None:
    """Write the partitions of a table that `df` has rows for; all others keep their files.

    By path, as Spark refuses a table that is both read and overwritten. With dynamic
    partitions that is safe: files are replaced only after all new ones are written.
    """
    spark = df.sparkSession
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    details = dict(
        (r["col_name"], r["data_type"])
        for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    )
    writer = df.select(*spark.table(name).columns).write.mode("overwrite").partitionBy(*parts)
    writer.option("partitionOverwriteMode", "dynamic").parquet(details["Location"])
    if details.get("Partition Provider") == "Catalog":
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)


def merge_into_table(
    source: DataFrame, name: str, keys: list[str], update_columns: list[str] | None = None
) -> None:
    """Upsert into a partitioned table whose partition columns are among the keys.

    Only partitions that the source has rows for are read and written again, once; a
    partition is replaced when its new files are complete. A row without a value for a
    partition column matches nothing and is added to its own partition.
    """
    spark = source.sparkSession
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if not parts or not set(parts) <= set(keys):
        raise ValueError(f"{name} must be partitioned by some of the keys {keys}")
    target = spark.table(name)
    touched = source.select(*[F.col(c).alias(f"_{c}") for c in parts]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts]
    merged = merge_upsert(target.join(touched, same, "left_semi"), source, keys, update_columns)
    replace_partitions(merged, name)


def _as_audit_rows(df: DataFrame, table: str) -> DataFrame:
    """Columns, types and defaults of the audit table; what is missing is NULL."""
    defaults = schemas.AUDIT_DEFAULTS[table]
    columns = []
    for field in schemas.AUDIT[table].fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def findings_rows(findings: DataFrame, run_id: str) -> DataFrame:
    """Run findings as rows of the findings table, the evidence as JSON."""
    delta = (F.col("metric_value") - F.col("baseline_value")) / F.nullif(
        "baseline_value", F.lit(0.0)
    ) * 100
    return _as_audit_rows(
        findings.select(
            "finding_id",
            F.lit(run_id).alias("run_id"),
            "detected_at",
            F.col("category").alias("finding_type"),
            F.upper("severity").alias("severity"),
            F.col("affected_resource").alias("resource_id"),
            "metric_value",
            "baseline_value",
            delta.alias("delta_pct"),
            F.col("title").alias("headline"),
            F.col("description").alias("explanation"),
            F.coalesce("evidence", F.lit("{}")).alias("raw_data"),
        ),
        "findings",
    )


def recommendations_rows(recommendations: DataFrame, run_id: str, created_at: datetime):
    """Recommendations as rows of the audit table.

    Takes both kinds: parsed from responses (`action_type`, `target_resource`, ...) and
    from the savings operators, which already use the table's names.
    """
    renames = {
        "action_type": "recommendation_type",
        "target_resource": "resource_id",
        "estimated_monthly_savings_usd": "expected_savings_usd_monthly",
    }
    df = recommendations.withColumnsRenamed(
        {old: new for old, new in renames.items() if old in recommendations.columns}
    )
    steps = F.lit(None).cast("string")
    if "finding_ids" in df.columns:
        parts = [F.col(c) for c in ("suggested_command", "finding_ids") if c in df.columns]
        steps = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return _as_audit_rows(
        df.withColumns({
            "run_id": F.lit(run_id),
            "created_at": F.lit(created_at),
            "confidence": F.upper("confidence"),
            "implementation_steps": steps,
        }),
        "recommendations",
    )


def run_row(
    findings: DataFrame,
    recommendations: DataFrame,
    metrics: DataFrame,
    run_id: str,
    started_at: datetime,
    ended_at: datetime,
    triggered_by: str = "manual",
    mode: str = "daily",
    dry_run: bool = False,
    config: dict | None = None,
    timings: dict | None = None,
    errors: list[str] | None = None,
    calls: DataFrame | None = None,
    report: DataFrame | None = None,
) -> DataFrame:
    """One row about the run: settings, metrics, timings and report as JSON, and counts.

    `calls` is the rollup of model calls per run and endpoint, of which this run's are
    counted; `report` has the run's texts in its column `markdown`, one per report.
    """
    kept = {"ignoreNullFields": "false"}

    def literal(values: dict):
        fields = [F.lit(v).alias(k) for k, v in values.items()]
        return F.struct(*fields) if fields else F.lit(None).cast("struct<none:string>")

    # One row from each source, with the columns that it knows.
    known = findings.agg(F.count("*").alias("f"))
    known = known.unionByName(recommendations.agg(F.count("*").alias("r")), True)
    summary = F.to_json(F.struct(*metrics.columns), kept)
    known = known.unionByName(metrics.select(summary.alias("m")), True)
    empty = findings.sparkSession.range(0)
    made = empty.select(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("t"))
    if calls is not None:
        made = calls.where(F.col("run_id") == run_id).agg(
            F.sum("calls").alias("c"), F.sum("total_tokens").alias("t")
        )
    known = known.unionByName(made, True)
    text = empty.select(F.lit("").alias("p"))
    if report is not None:
        texts = F.transform(
            F.array_sort(F.collect_list(F.struct("report", "markdown"))), lambda x: x["markdown"]
        )
        text = report.agg(F.array_join(texts, "\n\n").alias("p"))
    one = known.unionByName(text, True).agg(
        F.sum("f").alias("findings_count"),
        F.sum("r").alias("recommendations_count"),
        F.max("m").alias("metrics"),
        F.sum("c").alias("llm_calls"),
        F.sum("t").alias("llm_tokens"),
        F.coalesce(F.max("p"), F.lit("")).alias("report_markdown"),
    )
    snapshot = F.concat(
        F.lit('{"config":'), F.coalesce(F.to_json(literal(config or {}), kept), F.lit("{}")),
        F.lit(',"summary_metrics":'), F.col("metrics"),
        F.lit(',"node_timings_ms":'),
        F.coalesce(F.to_json(literal(timings or {}), kept), F.lit("{}")),
        F.lit(","),
        F.substring(F.to_json(F.struct("report_markdown")), 2, 1 << 30),
    )
    error_text = F.to_json(F.array(*[F.lit(e) for e in errors])) if errors else F.lit(None)
    return _as_audit_rows(
        one.select(
            F.lit(run_id).alias("run_id"),
            F.lit(started_at).alias("started_at"),
            F.lit(ended_at).alias("ended_at"),
            F.lit("FAILED" if errors else "SUCCESS").alias("status"),
            F.lit(triggered_by).alias("triggered_by"),
            F.lit(mode).alias("mode"),
            F.lit(dry_run).alias("dry_run"),
            F.lit((config or {}).get("lookback_days")).alias("lookback_days"),
            snapshot.alias("config_snapshot"),
            error_text.alias("error_message"),
            F.lit((ended_at - started_at).total_seconds()).alias("duration_seconds"),
            "findings_count",
            "recommendations_count",
            "llm_calls",
            "llm_tokens",
        ),
        "runs",
    )


def _storable(rows: DataFrame, table: str) -> DataFrame:
    """The rows with the day of their time; one that lacks a required value is an error.

    Parquet columns are nullable whatever the table says, so the check is part of the
    write: it sits in the written column and cannot be pruned.
    """
    required = [f.name for f in schemas.AUDIT[table].fields if not f.nullable]
    lacking = sorted(set(required) - set(rows.columns))
    if lacking:
        raise ValueError(f"{table} requires {lacking}")
    checked = {
        c: F.when(
            F.col(c).isNull(), F.raise_error(F.lit(f"{c} of {table} is required"))
            .cast(rows.schema[c].dataType)
        ).otherwise(F.col(c))
        for c in required
    }
    day = F.to_date(schemas.AUDIT_TIME_COLUMN[table])
    return rows.withColumns(checked).withColumn(_day_column(table), day)


def append_audit(rows: DataFrame, database: str, table: str, dry_run: bool = False) -> None:
    """Append to an audit table; a dry run writes nothing."""
    if not dry_run:
        write_table(_storable(rows, table), f"{database}.{table}", mode="append")


def insert_partial(rows: DataFrame, database: str, table: str) -> None:
    """Append rows that have only some of the columns; the catalog's defaults fill the rest."""
    stored = _storable(rows, table)
    columns = ", ".join(stored.columns)
    stored.sparkSession.sql(
        f"INSERT INTO {database}.{table} ({columns}) SELECT {columns} FROM {{rows}}", rows=stored
    )


def replace_run(rows: DataFrame, database: str, table: str, run_id: str) -> None:
    """Store the rows of a run in place of those that an earlier attempt of it stored.

    Only the days that the run has or had rows on are written again, with the rows of other
    runs as they were; no rows at all remove the earlier ones. The rows are evaluated once, into a table of
    their own, so a failure before the exchange of files leaves what was stored. A row of another
    run is an error. Runs that share a day must not be stored at the same time.
    """
    spark, name, day = rows.sparkSession, f"{database}.{table}", _day_column(table)
    staged = f"{database}.{table}_{uuid.uuid4().hex[:12]}"
    other = F.raise_error(F.lit(f"a row of another run than {run_id}"))
    checked = F.when(F.col("run_id") == run_id, F.col("run_id")).otherwise(other)
    write_table(_storable(rows, table).withColumn("run_id", checked), staged)

    def days_of(df: DataFrame) -> set:
        return {r[0] for r in df.select(day).distinct().collect()}

    old, new = spark.table(name), spark.table(staged)
    had, has = days_of(old.where(F.col("run_id") == run_id)), days_of(new)
    kept = old.where(F.col(day).isin(had | has) & (F.col("run_id") != run_id))
    emptied = had - has - days_of(kept)
    replace_partitions(kept.unionByName(new, allowMissingColumns=True), name)
    for date in sorted(emptied):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({day} = DATE '{date}')")
    spark.sql(f"DROP TABLE {staged}")
