"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long, no nulls) -> (id, component): the smallest id that each linked id reaches.

    Alternates large-star and small-star steps until the links don't change; every step is a minimum per node (with map-side
    combining) and a join that Spark can split where a node has very many links. Each round is written to the shared folder.
    The number of links never grows and labels only fall, so the rounds end, after a few more than the logarithm of the longest path.
    Links from an id to itself and repeated links don't matter; ids with no other link don't appear.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).head()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.where("hi > lo").distinct(), "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialise(least.select("hi", F.col("m").alias("lo")).unionByName(small).distinct(), "small-star")
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)
