"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import saved


def _stamp(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``links(a, b)`` but the roots: comp
    is the smallest node that can be reached.

    Each step hangs neighbours below the smallest one (first the larger, then
    the smaller neighbours); minima are combined before they are shuffled and
    joined back, so that no neighbour list is ever gathered.  Steps grow with
    the logarithm of the longest chain; each is written, and only a count and
    a checksum come to the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = saved(edges, "links")
    stamp = _stamp(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (small.select("a", F.col("m").alias("b"))
                 .union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        edges, before = saved(small, "small"), stamp
        stamp = _stamp(edges)
        if stamp == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
