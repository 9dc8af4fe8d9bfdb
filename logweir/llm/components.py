"""Connected components of a table of links, by alternating large and small stars.

Each round joins a node's links with its smallest neighbour; rounds go on until nothing changes, a number that grows
with the logarithm of the longest chain. Links stay in tables: each round's result is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def stars(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v. Large: all greater neighbours of a node link to its smallest; small: all smaller ones."""
    ways = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    if large:
        return ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every linked node: the smallest node that it reaches. links: (a, b)."""
    flat = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now = cut(flat, "links")
    mark = None
    for _ in range(most_rounds):
        before, now = now, cut(stars(stars(now, True), False), "stars")
        discard(links.sparkSession, before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    out.written_to = now.written_to
    return out
