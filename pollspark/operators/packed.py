"""Posterior draws packed as arrays: one row per unit, time and block of draws instead of one per draw.

Sums over units are element by element, by an aggregate that adds up arrays before the
shuffle, so a country of any number of regions is no group that a task would gather, and
keys travel once per block of draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark.operators.relate import inner_join

BLOCK = 512


def pack_draws(draws: DataFrame, keys: Sequence[str], draw: str, value: str, block: int = BLOCK) -> DataFrame:
    """``(keys, block, value)``: ``value`` as arrays of ``block`` consecutive draws from 0, null where a draw is absent.

    One row a key and draw; of repeated ones the greatest value is taken. The last block
    ends with the last draw of the table.
    """
    last = draws.agg(F.max(draw).alias("d"))
    number = F.col(draw).cast("long")
    entry = F.struct((number % block).cast("int").alias("at"), F.col(value).cast("double").alias("x"))
    once = draws.groupBy(*keys, draw).agg(F.max(value).alias(value))
    held = once.groupBy(*keys, F.floor(number / block).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("xs"))
    size = F.least(F.lit(block), last.scalar().cast("long") + 1 - F.col("block") * block).cast("int")
    held = held.withColumn("size", size)
    places = F.sequence(F.lit(0), F.col("size") - 1)
    gaps = F.transform(places, lambda i: F.try_element_at(F.filter("xs", lambda e: e["at"] == i), F.lit(1))["x"])
    whole = F.when(F.size("xs") == F.col("size"), F.col("xs.x")).otherwise(gaps)
    return held.select(*keys, "block", whole.alias(value))


def unpack_draws(packed: DataFrame, value: str, draw: str = "draw", block: int = BLOCK) -> DataFrame:
    """One row per draw again; absent draws have none."""
    keys = [c for c in packed.columns if c not in ("block", value)]
    rows = packed.select(*keys, "block", F.posexplode(value).alias("at", value)).where(F.col(value).isNotNull())
    return rows.select(*keys, (F.col("block") * block + F.col("at")).alias(draw), value)


def packed_region_scores(
    country_walk: DataFrame, region_effect: DataFrame, regions: DataFrame, time: Sequence[str] = ("year_int",)
) -> DataFrame:
    """``region_scores`` of packed tables: walk plus effect, draw by draw."""
    placed = inner_join(region_effect, regions, ["mergekey"])
    joined = inner_join(placed, country_walk, ["iso_3166", *time, "block"])
    return joined.withColumn("region_alpha", F.zip_with("country_alpha", "region_effect", lambda a, b: a + b))


def packed_poststratify(
    region: DataFrame, weights: DataFrame, score: str, time: Sequence[str] = ("year_int",), renormalise: bool = False,
    name: str = "country_poststrat",
) -> DataFrame:
    """``poststratify`` of packed tables: the weighted sum over the regions that have the draw, null where none has."""
    joined = inner_join(region, weights.select("mergekey", "wt"), ["mergekey"])

    def total(values: Column) -> Column:
        return vector_to_array(Summarizer.sum(array_to_vector(values), F.col("wt")))

    there = F.transform(score, lambda x: x.isNotNull().cast("double"))
    filled = F.transform(score, lambda x: F.coalesce(x, F.lit(0.0)))
    sums = joined.where(F.col("wt") > 0).groupBy("iso_3166", *time, "block").agg(total(filled).alias("__s"), total(there).alias("__w"))
    share = (lambda s, w: F.when(w > 0, s / w)) if renormalise else (lambda s, w: F.when(w > 0, s))
    return sums.select("iso_3166", *time, "block", F.zip_with("__s", "__w", share).alias(name))
