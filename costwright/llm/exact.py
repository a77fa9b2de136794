"""Exact deduplication by progressive refinement.

Rows are grouped by the length of their texts, then by the hash of a short prefix, and only
what shares both with another row has its whole content read and hashed. No text is shuffled:
the keys that occur twice or more go back to the scan as bitmaps of a fixed size. A bitmap may let a
single row through, which costs a hash and changes nothing, as the last grouping is by length and SHA-256.
Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.llm.shared import marked, removed, repeated_keys, written

#: Characters of a text that its prefix hash covers.
PREFIX_CHARS = 64


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    normal: Callable[[Column], Column] = lambda c: c,
    digest_all: bool = False,
) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too.

    Rows are copies when their normalised texts are identical; null counts as empty, so null
    and empty texts are copies of each other. Of a group the row with the largest id stays; a null id is
    less than any other, and of rows that share the largest id exactly one has kept = true. text_sha256 is
    null for rows whose content did not have to be read, unless digest_all asks for all. An empty table
    gives no rows; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(normal(F.col(text)), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.octet_length("text").cast("long"))
    by_size = F.xxhash64("size")
    by_prefix = F.xxhash64("size", F.substring("text", 1, PREFIX_CHARS))

    sizes = written(repeated_keys(rows, by_size), "sizes")
    same_size = marked(rows, by_size, sizes, "same_size")
    prefixes = written(repeated_keys(same_size.filter("same_size"), by_prefix), "prefixes")
    same_prefix = marked(same_size, by_prefix, prefixes, "same_prefix")
    open_row = F.col("same_size") & F.col("same_prefix")
    full = F.unhex(F.sha2("text", 256))
    keyed = same_prefix.select(
        "id", "row", "size", open_row.alias("open"), (full if digest_all else F.when(open_row, full)).alias("full")
    )
    keyed = written(keyed, "keyed")
    removed(sizes)
    removed(prefixes)

    groups = (
        keyed.filter("open")
        .groupBy("size", "full")
        .agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    )
    copies = keyed.filter("open").join(groups, ["size", "full"]).select(
        "id", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "full"
    )
    alone = keyed.filter("not open").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full"
    )
    return copies.unionByName(alone).select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.lower(F.hex("full")).alias("text_sha256")
    )
