"""Connected components of a table of links, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.session import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    """Each link from either end, one row a link (``u``, ``v``), without loops."""
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return links.select("u", "v").unionByName(back).where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, root)``: the smallest node reachable over ``links`` (``u``, ``v``), for linked nodes.

    Large-star and small-star steps in turn: each node's larger neighbours move to its
    smallest neighbour, then its smaller ones do. The number of rounds grows with the
    logarithm of the longest path. Minima are pre-aggregated before the shuffle, so a
    node with very many links is no group that a task would hold. Every round is
    written to the shared folder, which cuts the lineage and survives lost executors.
    No links: no rows. ``rounds`` is a guard against endless loops and raises.
    """
    now = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        near = _both_ways(now)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        after = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = materialise(after)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
