"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the smallest node that can be reached.

    No neighbourhood is ever collected: a step takes minima by node and joins them back. Each round's edges are settled, so
    lineage stays short. It ends when the edges are stars: each upper end has one edge and is nobody's lower end.
    """
    edges, older = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = settle(small, "edges")
        if older is not None:
            release(older)
        older = edges
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("upper"), F.lit(0).alias("lower")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("upper"), F.lit(1).alias("lower")))
        if ends.groupBy("node").agg(F.sum("upper").alias("upper"), F.max("lower").alias("lower")).filter("upper > 1 OR (upper > 0 AND lower > 0)").isEmpty():
            break
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
