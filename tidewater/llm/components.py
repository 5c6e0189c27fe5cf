"""Connected components of a table of links, by large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written


def _hash(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """links: a, b (ids of linked nodes, any order, repeats allowed). Returns node, component: its smallest reachable id.

    Only linked nodes are returned; links to itself and nulls are ignored. Every step hangs the neighbours of a node on
    their smallest node: the larger ones first, then the smaller ones. Both are one aggregation, combined before its
    shuffle, and one join, whose hot keys Spark can split; a star is done in one step, a chain in about the logarithm
    of its length. Steps are written to the shared folder, and end when the links no longer change.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = written(edges, "links")
    before = _hash(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        edges = written(small.union(down.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _hash(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
