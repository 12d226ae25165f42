"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, kept


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, as a written table: root is the smallest node it reaches. links: columns u and v.

    Every step is a grouping with map-side minima, written, and a join by node: that join reads plain exchanges, so Spark
    splits the partition of a node with very many links (a star's hub). Each round is written to the shared folder,
    which cuts the lineage; rounds end when the links stay the same, after about log2 of the longest path. Null nodes and
    loops are left out.
    """
    e = kept(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = kept(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
        forget(e, least)
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = kept(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        forget(large, least)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = kept(roots, "components")
    forget(e)
    return out
