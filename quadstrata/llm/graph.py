"""Connected components: smallest label reachable, by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise, release


def components(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """edges (a, b) of comparable ids -> node, root (the smallest node of its component), for nodes on an edge.

    Alternating large-star and small-star contraction: each round is two aggregations,
    the rounds grow with the logarithm of the component size, and the edges never exceed
    their first number.  A hot node is aggregated map-side, and split in parts of about ``most``
    edges where its minimum goes back to them; nothing is collected.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, old = materialise(e, "edges"), None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_spread(both, low, "a", "n", "b", most).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, low, "a", "n", "b", most).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        small = materialise(small, "edges")
        now = small.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        release(e)
        release(large)
        e = small
        if now == old:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        old = now
