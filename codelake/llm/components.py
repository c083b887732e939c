"""Connected components of a table of links, by alternating stars.

Each round rewires every node's larger neighbours, then its smaller ones, to the smallest node it
knows; after a few rounds every component is a star.  Links stay a table throughout; each round is
written to the shared folder, and only two numbers per round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """From links (a, b) to (node, root): root is the smallest node reachable; roots themselves are left out."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    seen = None
    for _ in range(max_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        links = materialise(_small_star(_large_star(links)), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
