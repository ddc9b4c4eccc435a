"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import stage


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Hook neighbours (u, v) to the least node near u: the larger neighbours, or the smaller ones and u itself."""
    both = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).withColumnRenamed("u", "center")
    near = both.join(least, F.col("u") == F.col("center"))
    if small:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("center").alias("u"), F.col("m").alias("v")))
    else:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def _done(links: DataFrame) -> bool:
    """Whether every node but the roots has one link, to a root: one count a node says so, without another round."""
    up, down = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v): the least node that it reaches.

    Each round is a few joins over the links, written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Nodes with very many links are split by adaptive execution.
    """
    now = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "stars")
    while not _done(now):
        now = stage(_stars(_stars(now, small=False), small=True), "stars")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
