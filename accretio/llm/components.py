"""Connected components of a link table, by alternating large and small stars.

Each pass sends every node's neighbours to the smallest of them, until the links
are stars around the smallest node of each component. Minima are taken before
the shuffle, so a node with very many links is no hot key there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _sum_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b long): the least node it is connected to.

    Empty links give no rows; links of a node to itself, and repeated links, count once.
    """
    edges = written(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before = _sum_of(edges)
    while before[0]:
        # large star: a's larger neighbours go to the least of a and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # (minima are written so that the join with them can split a node of many links)
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where(F.col("a") != F.col("b")).distinct(), "links")
        # small star: a and its smaller neighbours go to the least of these
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.where(F.col("a") != F.col("b")).distinct(), "links")
        now = _sum_of(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
