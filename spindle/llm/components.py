"""Connected components of a link table, by alternating star contraction.

Every round turns each node's neighbours towards its smallest neighbour
(large star, then small star), which ends with every node linked to the least
node of its component after a number of rounds logarithmic in the longest
path.  Rounds are written to the shared folder; only their sizes and checksums
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.store import Workspace


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"))
    least = least.select("u", F.least("u", "_m").alias("_m"))
    joined = both.join(least, "u")
    if small:  # u > v in every edge: all of u's neighbours and u itself go to the least
        out = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(least.select("u", F.col("_m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``links`` (columns u, v; bigint): the label is the component's least node."""
    now = work.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        after = work.write(_star(_star(now, small=False), small=True), "round")
        size = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
        work.drop(now)
        now = after
        if tuple(size) == before:
            break
        before = tuple(size)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
