"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.session import StoredTable


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds (published method): every node ties its larger
    neighbours, then its smaller ones, to the smallest node it knows, until each component is a
    star. Minima are taken before the shuffle, so hubs do no harm, and every round is written to
    the shared folder, so a lost executor costs one round. The number of rounds grows with the
    logarithm of the longest path.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    state = {"n": F.count("*"), "sum": F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))}
    now = StoredTable(edges.filter("a <> b").select(larger, smaller).distinct(), **state)
    while True:
        # each node's smallest neighbour; its larger neighbours are tied to it
        both = now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m"))
        big = now.df.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
        # each node's smaller neighbours, and itself, are tied to the smallest of them
        least = big.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        ties = big.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ties = ties.filter("a <> b").union(least.select("u", "m"))
        then = StoredTable(ties.select(larger, smaller).distinct(), **state)
        done = then.metrics == now.metrics
        now.drop()
        now = then
        if done:
            break
    stars = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


class Sets:
    """Union-find over small numbers, for what one task holds."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j
