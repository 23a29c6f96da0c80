"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) of longs -> (node, component) for every node with an edge; the component is its smallest node.

    Each round links the larger neighbours of every node to its smallest neighbour, and then the smaller ones. Minima
    are combined before the shuffle, and a node with very many edges meets one row in a join that Spark may split.
    Rounds grow with the logarithm of the longest path; each is written to the shared folder."""
    pairs = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.write(large, "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, pairs = pairs, scratch.write(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "round")
        scratch.drop(before, large)
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(pairs.select("lo", "lo").distinct())
