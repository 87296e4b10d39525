"""Scaling, ordering, top rows, running sums, long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollspark.functions.columns import finite
from pollspark.operators.ranking import global_position, median, row_numbers
from pollspark.operators.relate import left_join, one_row, with_group


#: A standard deviation below this part of the greatest absolute value is rounding noise.
NOISE = 1e-12


def standardise(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """``(x - mean) / sd`` with the sample sd; missing where the sd is missing or no more than
    rounding noise (``NOISE`` times the greatest value).

    Over the whole table the two moments come from a scalar subquery; inside
    groups from an aggregate joined back.
    """
    name = name or col + "_std"
    noise = F.lit(NOISE) * F.max(F.abs(F.col(col)))
    sd = F.stddev_samp(col)
    moments = [F.avg(col).alias("__mu"), F.when(sd > noise, sd).alias("__sd")]
    if by:
        joined = with_group(df, by, *moments)
        return joined.withColumn(name, _scaled(col, F.col("__mu"), F.col("__sd"))).drop("__mu", "__sd")
    row = one_row(df.agg(*moments))
    return df.withColumn("__s", row).withColumn(name, _scaled(col, F.col("__s.__mu"), F.col("__s.__sd"))).drop("__s")


def _scaled(col: str, mu: Column, sd: Column) -> Column:
    return F.when(sd > 0, (F.col(col) - mu) / sd)


def rescale01(df: DataFrame, col: str, name: str) -> DataFrame:
    """Map the finite range of a column onto [0, 1]."""
    value = finite(col)
    row = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    scaled = F.try_divide(F.col(col) - F.col("__r.lo"), F.col("__r.hi") - F.col("__r.lo"))
    return df.withColumn("__r", row).withColumn(name, scaled).drop("__r")


def last_observed(df: DataFrame, key: str, order: str, final: str) -> DataFrame:
    """The latest observed row per key; keys observed in the final period are
    dropped after the choice, not before."""
    rest = [c for c in df.columns if c != key]
    latest = df.where(F.col("obs") > 0).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return latest.select(key, *[F.col(f"__last.{c}").alias(c) for c in rest]).where(F.col(order) != final)


def extremes(
    df: DataFrame, col: str, n: int, key: str, by: Sequence[str] = (), side: str = "side", top: str = "top"
) -> DataFrame:
    """The ``n`` largest and ``n`` smallest rows, over all rows or per group.

    ``key`` breaks ties. A row can be in both ends, then it appears twice.
    """
    present = df.where(F.col(col).isNotNull())
    ends = []
    for label, order in (("top", F.desc(col)), ("bottom", F.asc(col))):
        if by:
            window = Window.partitionBy(*by).orderBy(order, key)
            ranked = present.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n).drop("__n")
        else:
            ranked = present.orderBy(order, key).limit(n)
        ends.append(ranked.withColumn(side, F.lit(label)))
    return ends[0].unionByName(ends[1])


def reorder(df: DataFrame, category: str, value: str, name: str = "rank") -> DataFrame:
    """Rank of each category by the median of its values (ties by name), on its rows."""
    centres = median(df, value, [category], "__centre")
    placed = row_numbers(centres, [F.col("__centre").asc_nulls_last(), F.col(category)], name)
    return left_join(df, placed.select(category, name), category)


def half_groups(df: DataFrame, order: Sequence[Column], name: str = "half") -> DataFrame:
    """1 for the first ``round(n / 2)`` rows in order, 2 for the others."""
    size = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    numbered = row_numbers(df, order, "__row")
    return numbered.withColumn(name, F.when(F.col("__row") <= F.bround(size / 2), 1).otherwise(2)).drop("__row")


def random_walk(steps: DataFrame, unit: Sequence[str], time: str, step: str, scale: Column, name: str) -> DataFrame:
    """Running sum of steps over the periods of a unit, times the step size."""
    past = Window.partitionBy(*unit).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn(name, F.sum(step).over(past) * scale)


def encode(df: DataFrame, col: str, name: str) -> DataFrame:
    """Dense integer codes 1.. of the sorted levels."""
    levels = df.select(col).where(F.col(col).isNotNull()).distinct()
    codes = global_position(levels, [F.col(col)], name=name).withColumn(name, (F.col(name) + 1).cast("int"))
    return left_join(df, codes, col)


def pivot_wider(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide over an explicit list of names.

    A name that the list lacks, a missing one too, is refused, not dropped (one aggregate
    row is read to see). Of several values for one place the largest is taken, whatever the order.
    """
    listed = list(names)
    unlisted = df.where(~F.coalesce(F.col(name).isin(listed), F.lit(False))).agg(F.min(name), F.count(F.lit(1))).first()
    if unlisted[1]:
        raise ValueError(f"{unlisted[1]} rows have names that are not listed, such as {unlisted[0]!r}")
    return df.groupBy(*ids).pivot(name, listed).agg(F.max(value))


def pivot_longer(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)
