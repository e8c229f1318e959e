"""Connected components of a graph whose edges are a DataFrame, by alternating large-star and small-star steps.

Every step joins edges with the least neighbour of their end (an aggregate with map-side combining), so no node's edges are
collected in one place. Steps run until the edges stay the same, however many that takes; each is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = written(least.select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        return both.join(least, both["a"] == least["u"]).where(F.col("b") > F.col("a")).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = written(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
    linked = edges.join(least, edges["a"] == least["u"]).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of the edges (a, b)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.agg(digest).first()[0]
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        now = written(_star(written(_star(now, True), "large"), False), "small")
        after = now.agg(digest).first()[0]
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
