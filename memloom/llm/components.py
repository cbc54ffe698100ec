"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links has a > b. large: every node's larger neighbours go to its least one; small: its smaller ones do."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return moved.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): one row per node that isn't the least of its component: node, root (the least)."""
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, before = seen, now
        now = cut(_star(_star(now, True), False))
        drop_cut(before)
