"""Bronze layer: the columns kept from each billing source."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from costwright import schemas
from costwright.functions.dates import last_days

MISSING = {"TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "SCHEMA_NOT_FOUND"}


def load_or_empty(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    """A table (or a parquet path, if it holds a slash); empty when it is not there.

    The empty table has the full schema, so every reader of it still works.
    """
    try:
        if "/" in source:
            return spark.read.parquet(source)
        return spark.table(source)
    except AnalysisException as error:
        if error.getCondition() not in MISSING:
            raise
        return spark.createDataFrame([], schema)


def billing_usage(source: DataFrame, as_of: date, days: int | None = 7) -> DataFrame:
    """Usage records of the window, or of all time (`days=None`), with a quantity above zero."""
    kept = [f.name for f in schemas.BILLING_USAGE.fields]
    used = F.col("usage_quantity") > 0
    return source.where(used if days is None else last_days(as_of, days) & used).select(
        *kept, F.date_format("usage_date", "yyyy-MM").alias("usage_month")
    )


def list_prices(source: DataFrame) -> DataFrame:
    return source.select(*schemas.LIST_PRICES.names)


def clusters(source: DataFrame) -> DataFrame:
    return source.select(*schemas.CLUSTERS.names)


def job_runs(source: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Run periods that start inside the window."""
    start = F.lit(as_of - timedelta(days=days)).cast("timestamp")
    end = F.lit(as_of + timedelta(days=1)).cast("timestamp")
    begins = F.col("period_start_time")
    return source.where((begins >= start) & (begins < end)).select(*schemas.JOB_RUNS.names)


def row_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """One row per layer table with its number of rows."""
    counts = None
    for name, df in layers.items():
        one = df.groupBy().agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts
