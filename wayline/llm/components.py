"""Connected components of links by alternating stars: joins and small groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step over pairs (a > b): each node ties its larger (or its own and smaller) neighbours to the least. What a shuffle brings is written on by ``parts`` tasks."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = both.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, root) for every node but the roots: root is the least node of its component.

    ``edges`` has the columns a and b, longs, in any order; null ends, loops and repeats are dropped. Work in
    a round is a few shuffles of the links; the number of rounds grows with the logarithm of the longest path.
    Each round ends in a checkpoint, and only a count and a sum come to the driver. As many tasks write as the count of links asks for, so that the
    many rounds of few links leave few files, whatever the number of shuffle partitions.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            return edges.select("a", F.col("b").alias("root"))
        before = seen
        parts = max(8, -(-seen[0] // 100_000))
        edges = _stars(_stars(edges, True, parts), False, parts).checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
