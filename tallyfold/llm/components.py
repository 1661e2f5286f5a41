"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join that Spark can split on a hot
node; state is a written table, nothing goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.session import Scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if small:
        down = edges.filter("a > b").unionByName(flipped.filter("a > b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
    both = edges.unionByName(flipped)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every linked node other than the roots; ``edges`` has the columns a and b.

    The root is the smallest node of the component.  Loops and repeated links do no harm.
    """
    cur = edges.filter("a <> b").select("a", "b").distinct()
    while True:
        big = scratch.cut(_star(cur, small=False), "large")
        scratch.drop(cur)
        cur = scratch.cut(_star(big, small=True), "small")
        scratch.drop(big)
        if _settled(cur):
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(stars: DataFrame) -> bool:
    """Does every node have one parent that has none itself?"""
    ends = stars.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        stars.select("b", F.lit(0), F.lit(1))
    )
    roles = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()
