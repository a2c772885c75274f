"""Connected components by alternating large-star and small-star steps.

Edges live in tables; each step is an aggregate (combined before the shuffle)
and a join on the node, written to the shared folder. The driver sees a count
and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import drop, stash


def _large(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for the nodes of ``edges`` (columns u, v) other than roots: the least node of each component is its root.

    Self-loops and repeated edges have no effect; no edges give no rows.
    """
    now, seen = stash(edges.select("u", "v").filter("u != v").distinct()), None
    while True:
        before, now = now, stash(_small(_large(now)))
        drop(before)
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
