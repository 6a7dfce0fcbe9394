"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorops.llm.common import materialize


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round joins every edge with the smallest neighbour of its ends, first
    towards larger nodes, then towards smaller ones, until the edges are stars
    around the roots. Rounds grow with the logarithm of a component's size. The
    smallest neighbour is a sum by key (combined before the shuffle), and the
    join on it is one that Spark can split when a root has very many members.
    Each round's edges are written to the shared folder; the driver sees their
    number and a checksum.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialize(e, "edges")
    last = None
    for _ in range(most_rounds):
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m")))
        e = materialize(small.filter("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
