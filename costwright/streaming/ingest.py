"""The scheduled ingest as an incremental query.

The daily job reads what arrived since the last run and stops. Enriching a record
needs no state, so the batch functions run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costwright.plans.silver import usage_enriched


def enrich_new_usage(
    usage: DataFrame, prices: DataFrame, as_of: date, target: str, checkpoint: str
) -> StreamingQuery:
    """Append silver rows for all new usage files to parquet under `target`, then stop.

    `checkpoint` remembers which files are done, so a rerun after a failure neither
    skips nor repeats one.
    """
    bronze = usage.where(F.col("usage_quantity") > 0).withColumn(
        "usage_month", F.date_format("usage_date", "yyyy-MM")
    )
    return (
        usage_enriched(bronze, prices, as_of)
        .writeStream.format("parquet")
        .partitionBy("usage_month")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
