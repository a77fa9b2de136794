"""The written layers of a folder of test tables, refreshed when its files have changed."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from costwright.sources import ingest
from costwright.sources.ingest import Layers
from workload import fixtures
from workload.fixtures import AS_OF, DAYS

# The newest layers per folder, with the state of the files that they were made from.
_STORED: dict[tuple[str, str], tuple[str, Layers]] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, lengths and times of the input files, by Spark's own file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return ";".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files))


def refreshed(spark: SparkSession, sf_dir: str) -> Layers:
    """Layers written anew, in schemas of their own."""
    prefix = f"costwright_{uuid.uuid4().hex[:12]}_"
    ingest.refresh(
        spark,
        fixtures.usage_source(spark, sf_dir),
        fixtures.price_source(spark, sf_dir),
        fixtures.cluster_source(spark, sf_dir),
        fixtures.job_run_source(spark, sf_dir),
        AS_OF,
        DAYS,
        prefix,
    )
    return Layers(spark, prefix)


def stored(spark: SparkSession, sf_dir: str) -> Layers:
    """The layers of a folder, written once per session for its present files."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, sf_dir)
    known = _STORED.get(key)
    if known is None or known[0] != state:
        known = _STORED[key] = state, refreshed(spark, sf_dir)
    return known[1]
