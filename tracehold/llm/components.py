"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import drop_stored, stored


def _stars(links: DataFrame) -> bool:
    """Whether every node is the larger end of one link, or the smaller end of any number."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select("b", F.lit(0).alias("up"), F.lit(1).alias("down")).withColumnRenamed("b", "node"))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); a component is its smallest node.

    Each round links every node to the smallest of its neighbours, once for the larger ones
    and once for the smaller ones; after some rounds (a logarithm of the longest path) only
    stars are left. Every round is a written table. Links from a node to itself, nulls and repeated
    links change nothing; no links give no rows.
    """
    spark = links.sparkSession
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, path = stored(links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(now):
        # larger neighbours go to the smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large, large_path = stored(large.where(F.col("a") != F.col("b")), "links")
        # smaller neighbours, and the node itself, go to the smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a")
        small = small.where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
            low.select("a", F.col("_m").alias("b"))).distinct()
        now, new_path = stored(small, "links")
        drop_stored(spark, path, large_path)
        path = new_path
    # stars now: each node once, linked to its centre
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
