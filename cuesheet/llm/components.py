"""Connected components of a graph given as edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b) that can reach a smaller node: ``label`` is the smallest of them.

    Rounds of large-star and small-star steps: each node hangs its larger neighbours, then itself and its smaller
    neighbours, on the smallest of them, until nothing changes.  A round is two grouped minima and joins on
    (node); the number of edges never grows, and the rounds are about the logarithm of the longest path.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = scratch.keep(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).distinct()
        before = mark
        ways = both(now)
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        large = scratch.keep(large, "large")
        # every edge now points from the larger node (a) to a smaller one (b)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = scratch.keep(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        scratch.drop(large, now)
        now = after
