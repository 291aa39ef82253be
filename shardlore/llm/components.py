"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, unsettle


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that a link (a, b) names.

    Rounds of large-star and small-star: each node's larger neighbours, then its smaller ones, are linked to the least node
    it knows, until nothing changes; the number of links never grows. Loops and repeated links are allowed."""
    e = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # Every larger neighbour of a is linked to the least of a and its neighbours.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        e, last = settle(small), e
        unsettle(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
