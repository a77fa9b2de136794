"""The bronze, silver and gold tables: full refresh, readers, and late records."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwright import schemas
from costwright.functions.dates import last_days
from costwright.plans import gold, silver
from costwright.sources import bronze
from costwright.sources.tables import replace_partitions, write_table

Source = str | DataFrame

LAYERS = ("bronze", "silver", "gold")

# Which rollup fills each gold table.
ROLLUPS = {
    "daily_cost": gold.daily_cost,
    "cost_by_user": gold.cost_by_user,
    "cost_by_tags": gold.cost_by_tags,
    "cost_by_resource": gold.cost_by_resource,
}


@dataclass(frozen=True)
class Layers:
    """The written layers under a prefix. Windows are literal ranges of the partition column."""

    spark: SparkSession
    prefix: str = ""

    def name(self, layer: str, table: str) -> str:
        return f"{self.prefix}{layer}.{table}"

    def usage_enriched(self, as_of: date, days: int) -> DataFrame:
        table = self.spark.table(self.name("silver", "usage_enriched"))
        return table.where(last_days(as_of, days))

    def rollup(self, table: str, as_of: date, days: int) -> DataFrame:
        """A gold table's window: daily_cost, cost_by_user, cost_by_tags or cost_by_resource."""
        return self.spark.table(self.name("gold", table)).where(last_days(as_of, days))

    def clusters(self) -> DataFrame:
        return self.spark.table(self.name("bronze", "clusters"))

    def prices(self) -> DataFrame:
        return self.spark.table(self.name("bronze", "list_prices"))


def refresh(
    spark: SparkSession,
    usage: Source,
    prices: Source,
    clusters: Source,
    job_runs: Source,
    as_of: date,
    days: int = 7,
    prefix: str = "",
) -> DataFrame:
    """Rebuild every layer from its sources; returns the rows per table.

    A source is a table's name, a path or a DataFrame. Usage must be readable. The other named
    sources may be missing, which makes their tables empty and usage unpriced. Each layer
    reads the written layer before it, so the price join runs once for all rollups. Usage
    and rollups are laid out by date, so later windows read only their own folders.
    """
    layers = Layers(spark, prefix)
    name = layers.name

    def keep(df: DataFrame, layer: str, table: str, *partition_by: str) -> DataFrame:
        write_table(df, name(layer, table), "overwrite", list(partition_by) or None)
        return spark.table(name(layer, table))

    def load(source: Source, schema):
        if isinstance(source, DataFrame):
            return source
        return bronze.load_or_empty(spark, source, schema)

    if isinstance(usage, str):
        usage = spark.read.parquet(usage) if "/" in usage else spark.table(usage)
    for layer in LAYERS:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {prefix}{layer}")

    raw = {
        "billing_usage": (by_date(bronze.billing_usage(usage, as_of, days)), "usage_date"),
        "list_prices": (bronze.list_prices(load(prices, schemas.LIST_PRICES)),),
        "clusters": (bronze.clusters(load(clusters, schemas.CLUSTERS)),),
        "job_runs": (bronze.job_runs(load(job_runs, schemas.JOB_RUNS), as_of, days),),
    }
    kept = at_once(
        lambda table: keep(raw[table][0], "bronze", table, *raw[table][1:]), raw
    )
    enriched = keep(
        by_date(silver.usage_enriched(kept["billing_usage"], kept["list_prices"], as_of)),
        "silver", "usage_enriched", "usage_date",
    )
    rollups = at_once(
        lambda table: keep(by_date(ROLLUPS[table](enriched)), "gold", table, "usage_date"), ROLLUPS
    )
    tables = {name("bronze", t): df for t, df in kept.items()}
    tables[name("silver", "usage_enriched")] = enriched
    tables |= {name("gold", t): df for t, df in rollups.items()}
    return bronze.row_counts(tables)


def at_once(write: Callable, names: Iterable[str]) -> dict:
    """Independent writes as concurrent Spark jobs, so that a small one does not leave cores idle."""
    names = list(names)
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(write, names)))


def by_date(df: DataFrame) -> DataFrame:
    """Rows gathered by date for the write: rows of all dates lie in every task, each of
    which would write a small file per date. AQE splits a date that grows too big."""
    return df.hint("rebalance", F.col("usage_date"))


def apply_late(layers: Layers, late: DataFrame, as_of: date) -> list[date]:
    """Bring silver and gold up to date with records that came late; returns the dates touched.

    `late` are bronze usage records. Only they are priced; silver partitions of their dates are
    written again with them, replacing records of the same id, so applying them twice changes
    nothing. Each rollup is recomputed for these dates alone. Other dates are neither read nor
    written: the dates, of which there are as many as days at most, become literals.
    """
    spark = layers.spark
    dates = sorted(r[0] for r in late.select("usage_date").distinct().collect() if r[0])
    if not dates:
        return dates
    target = layers.name("silver", "usage_enriched")
    touched = F.col("usage_date").isin(dates)
    kept = spark.table(target).where(touched).join(late.select("record_id"), "record_id", "left_anti")
    enriched = silver.usage_enriched(late.where(touched), layers.prices(), as_of)
    replace_partitions(by_date(kept.unionByName(enriched)), target)
    records = spark.table(target).where(touched)
    at_once(
        lambda table: replace_partitions(
            by_date(ROLLUPS[table](records)), layers.name("gold", table)
        ),
        ROLLUPS,
    )
    return dates
