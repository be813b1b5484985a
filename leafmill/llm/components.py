"""Connected components of a table of links, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in `links` (a, b): label is the smallest node reachable.

    Alternating large and small stars: each round hangs the larger (smaller)
    neighbours of a node on its smallest one; the number of links never grows, and
    a few rounds suffice. Every round is written to the shared folder. Self-links and
    repeated links are harmless; a link with a null end is left out.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def mark() -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # in `large` b is the smaller end
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                                F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut_lineage(small.filter("a <> b").distinct())
        now = mark()
        if now == before:
            break
        before = now
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
