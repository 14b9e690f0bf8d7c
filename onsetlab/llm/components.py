"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.llm.common import drop_written, new_place, written_at


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): the smallest node that links reach.

    Each round hangs neighbours onto smaller nodes; minima are combined before their
    shuffle and joined back, so a node with very many links is no single task's group.
    A round's links are written to the shared folder in place of those of the round before,
    and rounds end when nothing changed; their number grows with the logarithm of the
    longest chain, so there is no limit to it. Links with a null end and links to itself
    are left out."""
    spark = edges.sparkSession
    place = new_place(spark)
    e = written_at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), place)
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not mark[0] or mark == before:
            break
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, place = place, new_place(spark)
        e = written_at(small.distinct(), place)
        drop_written(spark, last)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


class Forest:
    """Union-find over positions, for the links that one task finds."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
