"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, root): root is the smallest reachable node.

    Alternates two star contractions until the edges are stars around their
    smallest member. Every step is a grouped minimum and an equality join, so
    a node with millions of neighbours is aggregated before it is shuffled and
    that minimum is stored before it is joined, so that Spark can split a hot
    node's rows. Each round is stored, which keeps the lineage short. An empty table gives an empty table; self-loops are ignored.
    """
    e = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = store(big.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = big.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low).distinct()
        e = store(small, "edges")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
