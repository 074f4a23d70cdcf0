"""Connected components of a table of links, by alternating stars of neighbours (no group is collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


#: Links up to which the least neighbours (16 bytes a node) are broadcast; beyond, they are joined by shuffle.
BROADCAST_LINKS = 1_000_000


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that links reach. Nodes are longs.

    Each round hangs the larger neighbours of a node on the least of them, then the smaller ones; stars are what is
    left in the end. Rounds grow with the logarithm of the longest path. Rows of a hub are joined, never gathered.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    told = F.broadcast if edges.count() <= BROADCAST_LINKS else lambda df: df
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(told(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(told(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components after {rounds} rounds not settled")
