"""Exact order statistics and ranks that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollspark.operators.relate import anti_join, left_join, semi_join
from pollspark.session import materialise

ACCURACY = 10_000
#: Distinct values of one bracket that a task ranks; a bracket with more is placed by range partitions.
BRACKET_ROWS = 1_000_000


def quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    accuracy: int = ACCURACY,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Exact interpolated (type 7) quantiles, one row per group; NaN is missing.

    Pass 1 keeps a mergeable sketch per group, which brackets every wanted order
    statistic (groups of up to ``accuracy`` values need no bracket). Pass 2 counts
    the values below each bracket, where partial aggregation folds them to one
    row per task, and keeps the distinct values inside; a task then ranks them. The
    counts show whether a bracket holds the wanted positions. A group with one that
    does not, or with more than ``bracket_rows`` values inside one, is placed by
    range partitions instead, so the answer never depends on the sketch.
    """
    names = list(names or [f"q{100 * p:g}" for p in probs])
    keys = list(by) or ["__all"]
    inf = float("inf")
    slack = 3.0 / accuracy
    number = F.col(col).cast("double")
    # A group with no value still gets a row, with missing quantiles.
    rows = df.select(*by, F.when(~F.isnan(number), number).alias("__v"))
    values = rows if by else rows.withColumn("__all", F.lit(0))
    edges = []
    for p in probs:
        edges += [max(p - slack, 0.0), min(p + slack, 1.0)]
    marks = values.groupBy(*keys).agg(
        F.count("__v").alias("__n"),
        F.percentile_approx("__v", F.array(*[F.lit(e) for e in edges]), accuracy).alias("__e"),
    )
    small = F.col("__n") <= accuracy

    def bracket(i: int) -> Column:
        low, high = F.get("__e", F.lit(2 * i)), F.get("__e", F.lit(2 * i + 1))
        return F.struct(
            F.lit(i).alias("i"),
            (F.lit(-inf) if edges[2 * i] == 0 else low).alias("low"),
            (F.lit(inf) if edges[2 * i + 1] == 1 else high).alias("high"),
        )

    # A small group is ranked once for all probabilities: bracket -1, open on both sides.
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-inf).alias("low"), F.lit(inf).alias("high")))
    brackets = F.when(small, whole).otherwise(F.array(*[bracket(i) for i in range(len(probs))]))
    # One row per group, written so that its size is known before the join: if it
    # fits under the broadcast threshold, the values are not shuffled for it.
    marked = materialise(marks.select(*keys, F.struct("__n", brackets.alias("bs")).alias("__b")))
    joined = left_join(values.where(F.col("__v").isNotNull()), marked, keys)
    inside = materialise(
        joined.select(*keys, "__v", F.col("__b.__n").alias("__n"), F.explode("__b.bs").alias("b"))
        .where(F.col("__v") <= F.col("b.high"))
        .select(
            *keys, "__n", F.col("b.i").alias("__i"), F.when(F.col("__v") >= F.col("b.low"), F.col("__v")).alias("__v")
        )
        .groupBy(*keys, "__n", "__i", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    positions = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]

    # Every bracket must hold its positions and be small enough for one task.
    held = inside.groupBy(*keys, "__n", "__i").agg(
        F.sum(F.when(F.col("__v").isNull(), F.col("__c")).otherwise(0)).alias("__below"),
        F.sum("__c").alias("__upto"), F.count(F.lit(1)).alias("__rows"),
    )
    outside = F.lit(False)
    for i, pos in enumerate(positions):
        outside = outside | ((F.col("__i") == i) & ((F.col("__below") > F.floor(pos)) | (F.col("__upto") <= F.ceil(pos))))
    wrong = materialise(held.where(outside | (F.col("__rows") > bracket_rows)).select(*keys).distinct())
    any_wrong = not wrong.isEmpty()
    if any_wrong:
        inside = anti_join(inside, wrong, keys)

    upto = Window.partitionBy(*keys, "__n", "__i").orderBy(F.col("__v").asc_nulls_first())
    ranked = inside.withColumn("__cum", F.sum("__c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    picked, columns = [], []
    for i, (pos, name) in enumerate(zip(positions, names, strict=True)):
        mine = F.col("__i").isin(-1, i)
        picked += [
            F.min(F.when(mine & (F.col("__cum") > F.floor(pos)), F.col("__v"))).alias(f"__lo{i}"),
            F.min(F.when(mine & (F.col("__cum") > F.ceil(pos)), F.col("__v"))).alias(f"__hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"__f{i}"),
        ]
        low = F.col(f"__lo{i}")
        columns.append((low + (F.col(f"__hi{i}") - low) * F.col(f"__f{i}")).alias(name))
    found = ranked.groupBy(*keys).agg(*picked)
    if any_wrong:
        found = found.unionByName(_placed(semi_join(values, wrong, keys), marked, keys, positions))
    result = left_join(marked.select(*keys), found.select(*keys, *columns), keys)
    if by:
        return result
    # One row even where there is no value at all.
    return result.agg(*[F.max(name).alias(name) for name in names])


def _placed(values: DataFrame, marked: DataFrame, keys: Sequence[str], positions: Sequence[Column]) -> DataFrame:
    """The order statistics next to each position, from the places of all values over range partitions."""
    placed = global_position(values.where(F.col("__v").isNotNull()), [F.col("__v")], by=keys, name="__at")
    sized = left_join(placed, marked.select(*keys, F.col("__b.__n").alias("__n")), keys)
    picked = []
    for i, pos in enumerate(positions):
        picked += [
            F.max(F.when(F.col("__at") == F.floor(pos), F.col("__v"))).alias(f"__lo{i}"),
            F.max(F.when(F.col("__at") == F.ceil(pos), F.col("__v"))).alias(f"__hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"__f{i}"),
        ]
    return sized.groupBy(*keys).agg(*picked)


def median(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return quantiles(df, col, [0.5], by, [name])


def approx_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Opt-in sketch answer, one aggregate pass."""
    sketch = F.percentile_approx(col, F.array(*[F.lit(float(p)) for p in probs]), ACCURACY)
    picked = df.groupBy(*by).agg(sketch.alias("__q"))
    return picked.select(*by, *[F.get("__q", F.lit(i)).alias(f"q{100 * p:g}") for i, p in enumerate(probs)])


def global_position(
    df: DataFrame,
    order: Sequence[Column],
    weight: str | None = None,
    by: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Sum of ``weight`` (default: 1 per row) over the rows strictly before, in order.

    Rows are range partitioned by ``(by, order)``; each partition is summed on
    its own and shifted by the totals of the partitions before it. The shift
    table has at most one row per partition and group, so no task sees a whole
    group. The partitioned rows are written once so that both uses agree.
    """
    by = list(by)
    w = F.lit(1) if weight is None else F.col(weight)
    keyed = df.select("*", w.cast("long").alias("__w"))
    ranged = materialise(
        keyed.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id())
    )
    totals = ranged.groupBy(*by, "__part").agg(F.sum("__w").alias("__total"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = left_join(ranged, shift, [*by, "__part"])
    position = F.col("__shift") + F.coalesce(F.sum("__w").over(within), F.lit(0))
    return joined.withColumn(name, position).drop("__w", "__part", "__shift")


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "row") -> DataFrame:
    """Global row number from 1. ``order`` should end in a unique key."""
    return global_position(df, order, name=name).withColumn(name, F.col(name) + 1)


def average_ranks(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """``(by, col, ties, rank)`` for each distinct value; ties share their mean rank."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("ties"))
    placed = global_position(counts, [F.col(col)], "ties", by, "__before")
    return placed.withColumn("rank", F.col("__before") + (F.col("ties") + 1) / 2).drop("__before")
