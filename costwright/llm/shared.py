"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the characters that bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local session without the setting gets a folder of its own, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context = spark.sparkContext
    if not hasattr(context, "_costwright_shared"):
        context._costwright_shared = tempfile.mkdtemp(prefix="shared-")
    return context._costwright_shared


#: Lets Spark delete the shuffle files of a statement when the statement ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table written in the shared folder and read back: cuts lineage, survives lost executors.

    Nothing needs the shuffle files behind it any more, so Spark deletes them at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing will read again."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        removed_folder(df.sparkSession, path)


def removed_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bits of a bitmap of keys: 512 rows of 4 KB, whatever the number of keys.
BITS = 1 << 24


def _bit(key: Column) -> Column:
    return key.bitwiseAND(F.lit(BITS - 1)) + 1


def repeated_keys(rows: DataFrame, key: Column, least: int = 2) -> DataFrame:
    """(bucket, bits): a bitmap of the keys (hashes as long) that so many rows or more have."""
    often = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    bit = _bit(F.col("key"))
    return often.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )


def marked(rows: DataFrame, key: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """rows with a further column: whether the bitmap holds their key; keys that share a bit are taken as held.

    The bitmap is broadcast, as its size is bounded.
    """
    place, bucket, bits = (unused(rows, c) for c in ("key_bit", "bucket", "bits"))
    bitmap = bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    rows = rows.withColumn(place, _bit(key)).withColumn(bucket, F.bitmap_bucket_number(place))
    byte = f"conv(hex(substring({bits}, cast(bitmap_bit_position({place}) div 8 as int) + 1, 1)), 16, 10)"
    bit = F.expr(f"shiftright(cast({byte} as int), cast(bitmap_bit_position({place}) % 8 as int)) & 1")
    found = rows.join(F.broadcast(bitmap), bucket, "left")
    return found.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(place, bucket, bits)


def id_text(column: str) -> Column:
    """An id as text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of an id's text, modulo folds."""
    return F.crc32(id_text(column).cast("binary")) % F.lit(folds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per Spark context."""
    import costwright

    context = spark.sparkContext
    if getattr(context, "_costwright_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(costwright.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), "costwright.zip")
    with zipfile.ZipFile(archive, "w") as package:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._costwright_shipped = True
