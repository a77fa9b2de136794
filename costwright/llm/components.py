"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwright.llm.shared import removed, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b: longs); component is the least node reachable.

    Each round joins every node to the least of its neighbourhood and is written to the shared
    folder; links then lie between a node and the least node that it knows. Rounds
    grow with the logarithm of a component's size. Loops and repeated links do no harm.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo")
    edges, before = written(edges.distinct(), "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if state == before or not state[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lower, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = written(small.unionByName(lower.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        removed(edges)
        edges = new
