"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges (a, b), both long; component is the smallest id that can
    be reached.  Rounds of two star steps (Kiveris et al., 2014) until nothing changes; each step takes
    a minimum by key, which is combined before the shuffle, so a hub's edges need not meet in a task
    (the joins back to the edges can be split).  Null ends and loops are ignored."""
    now = shared.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        now = shared.stage(small.where("a > b").distinct())
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return shared.stage(stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()))
