"""Connected components of a table of links, by alternating large and small stars.

Each round rewrites the links with aggregates and joins and is written to the
shared checkpoint folder; links and components stay in Spark. A star's centre
may have any number of links: minima are aggregated before the shuffle, and the
joins go to results of aggregates, so Spark can split a hot centre's partition.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import scratch


def star(pairs: DataFrame, both: bool) -> DataFrame:
    """One round: (u, v) with v the least neighbour known of u. `both`: large star, over all
    neighbours, moving the larger ones; else small star, over the smaller ones and the node itself."""
    if both:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.min("u").alias("w"))
    moved = pairs.join(least.select("w", "m"), F.col("u") == F.col("w"))
    moved = moved.where(F.col("v") > F.col("u")) if both else moved
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both:
        out = out.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (columns a, b); the component
    is its least node. Nulls and loops are left out; no links, no rows."""
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    pairs = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    before = None
    while True:
        path = scratch(spark, "components")
        pairs.write.parquet(path)
        pairs = spark.read.parquet(path)
        state = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                          F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        if not state.n or tuple(state) == before:
            break
        before = tuple(state)
        # Large star keeps u > v as pairs (larger, least); small star then points all to the least.
        pairs = star(star(pairs, True), False)
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
