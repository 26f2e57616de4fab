"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum with a map-side combine and a join on the node. A hub
with millions of neighbours is one row for each task before the shuffle, and in the
join its rows are spread by a salt (``common.spread_join``). Each round is written to
the shared folder and the round before it deleted: lineage stays short, and a lost
executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, spread_join


def _lowest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour (m) of each node (u), and its number of edges (n)."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, label): the smallest node of the component. Every node of an edge has a row."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    while new != mark:
        mark = new
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = _lowest(both).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, low, "u", "n", 2 * new[0], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("found.m").alias("v")).where("u <> v").distinct()
        low = _lowest(large)
        joined = spread_join(large, low, "u", "n", new[0], ["v"])
        small = joined.where("v <> found.m").select(F.col("v").alias("u"), F.col("found.m").alias("v")).union(low.select("u", "m"))
        was, now = now, materialise(small.distinct(), "edges")
        discard(was)
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    release(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
