"""From answers to count cells, region weights and model dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.operators.relate import union_all, with_group


def ordinal_counts(answers: DataFrame, geo: Sequence[str], period: Sequence[str]) -> DataFrame:
    """Answers per place, period, question and option (``yes``) and per cell (``size``).

    The large reduction of the pipeline: counting runs map-side first. The size
    is a window over the counts of one cell, which has one row per option.
    """
    keys = [*geo, *period, "question"]
    counts = answers.groupBy(*keys, "option").agg(F.count(F.lit(1)).alias("yes"))
    return counts.withColumn("size", F.sum("yes").over(Window.partitionBy(*keys)))


def store_cells(answers: DataFrame, folder: str, geo: Sequence[str], period: Sequence[str], source: str) -> None:
    """Add a wave of answers to the stored counts in ``folder``, by ``source`` and the first of ``period``.

    Only the parts that the wave has are written, and they replace what was stored of
    them: a wave may come again, and waves may come in any order. A wave holds all
    answers of its sources and periods.
    """
    keys = [source, *period, *geo, "question", "option"]
    counts = answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("yes"))
    # Copies name the parts, so that the columns themselves keep their types.
    parts = counts.withColumns({"__source": F.col(source).cast("string"), "__period": F.col(period[0]).cast("string")})
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__source", "__period").parquet(folder)


def merged_cells(spark: SparkSession, folder: str, geo: Sequence[str], period: Sequence[str]) -> DataFrame:
    """``ordinal_counts`` of all waves in ``folder``, from their counts instead of the answers."""
    stored = spark.read.parquet(folder)
    keys = [*geo, *period, "question"]
    counts = stored.groupBy(*keys, "option").agg(F.sum("yes").alias("yes"))
    return counts.withColumn("size", F.sum("yes").over(Window.partitionBy(*keys)))


def region_weights(pop: DataFrame, country: str, region: str, size: str) -> DataFrame:
    """Population share of each region in its country."""
    total = with_group(pop.select(country, region, size), [country], F.sum(size).alias("__total"))
    return total.withColumn("wt", F.col(size) / F.col("__total")).drop("__total")


def region_country(cells: DataFrame, region: str, country: str) -> DataFrame:
    """Region to country map; fails when a region lies in two countries."""
    pairs = cells.select(region, country).distinct()
    if pairs.groupBy(region).count().where(F.col("count") > 1).limit(1).count():
        raise ValueError(f"{region} lies in more than one {country}")
    return pairs


def drop_empty_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("size") != 0)


def _distinct_count(dfs: Sequence[DataFrame], col: str, name: str) -> DataFrame:
    return union_all(*[d.select(col) for d in dfs]).distinct().agg(F.count(col).alias(name))


def model_dims(cells: DataFrame, nat: DataFrame, country: str, region: str) -> DataFrame:
    """Sizes of the model: countries, periods, questions, regions (the largest code), options, cells;
    ``thresholds`` has one number per question, in the order of ``question_int``."""
    both = [cells, nat]
    shape = union_all(*[d.select("year_int", "option") for d in both]).agg(
        F.max("year_int").alias("tt"), F.max("option").alias("k")
    )
    counts = {
        "c": _distinct_count(both, country, "c"),
        "j": _distinct_count(both, "question", "j"),
        "r": cells.agg(F.max(region).alias("r")),
        "rtjk": cells.agg(F.count(F.lit(1)).alias("rtjk")),
        "ctjk": nat.agg(F.count(F.lit(1)).alias("ctjk")),
    }
    limits = union_all(*[d.select("question_int", "option") for d in both]).groupBy("question_int").agg(
        (F.max("option") - 1).alias("kmin1")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("question_int", "kmin1"))), lambda q: q["kmin1"].cast("string"))
    counts["thresholds"] = limits.agg(F.array_join(ordered, ",").alias("thresholds"))
    return shape.select("tt", "k", *[counted.scalar().alias(name) for name, counted in counts.items()])


def check_weights(weights: DataFrame, country: str, tol: float = 1e-9) -> None:
    """Fail unless weights are in [0, 1] and sum to 1 in every country."""
    total = weights.groupBy(country).agg(F.sum("wt").alias("s"), F.min("wt").alias("lo"))
    bad = total.where((F.abs(F.col("s") - 1) > tol) | (F.col("lo") < 0) | F.col("s").isNull())
    if bad.limit(1).count():
        raise ValueError("region weights must be in [0, 1] and sum to 1 per country")

