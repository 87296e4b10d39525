"""Joins and set operations.

No join carries a broadcast hint. Spark broadcasts a side whose size it knows to
be under ``spark.sql.autoBroadcastJoinThreshold`` (from statistics, or measured
at run time by adaptive execution) and otherwise shuffles, splitting hot
partitions (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str | tuple[str, str]]


def _pairs(on: Keys) -> list[tuple[str, str]]:
    keys = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in keys]


def _prepare(left: DataFrame, right: DataFrame, on: Keys, null_safe: bool):
    """Rename the right keys so that the condition is unambiguous."""
    pairs = _pairs(on)
    renamed = right.withColumnsRenamed({r: f"__key_{i}" for i, (_, r) in enumerate(pairs)})
    tests = []
    for i, (l, _) in enumerate(pairs):
        other = F.col(f"__key_{i}")
        tests.append(F.col(l).eqNullSafe(other) if null_safe else F.col(l) == other)
    condition: Column = reduce(lambda a, b: a & b, tests)
    return renamed, condition, [f"__key_{i}" for i in range(len(pairs))]


def left_join(left: DataFrame, right: DataFrame, on: Keys, null_safe: bool = True) -> DataFrame:
    """Left outer join; missing keys match missing keys when ``null_safe``.

    Columns of ``right`` that clash with ``left`` must be renamed beforehand.
    """
    renamed, condition, keys = _prepare(left, right, on, null_safe)
    return left.join(renamed, condition, "left").drop(*keys)


def full_join(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Full outer join with merged keys."""
    renamed, condition, keys = _prepare(left, right, on, null_safe)
    joined = left.join(renamed, condition, "full")
    merged = {k: F.coalesce(F.col(k), F.col(other)) for k, other in zip(on, keys, strict=True)}
    return joined.withColumns(merged).drop(*keys)


def inner_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | None = None,
    suffixes: tuple[str, str] = (".x", ".y"),
    null_safe: bool = True,
) -> DataFrame:
    """Inner join; without ``on``, natural join on all common columns.

    Missing keys match missing keys when ``null_safe``. Other columns present on
    both sides get the suffixes.
    """
    common = [c for c in left.columns if c in right.columns]
    keys = common if on is None else list(on)
    clash = [c for c in common if c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    renamed, condition, others = _prepare(left, right, keys, null_safe)
    return left.join(renamed, condition, "inner").drop(*others)


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left_join(left, right, [c for c in left.columns if c in right.columns])


def semi_join(left: DataFrame, right: DataFrame, on: Keys, null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``."""
    pairs = _pairs(on)
    renamed, condition, keys = _prepare(left, right.select(*[r for _, r in pairs]), on, null_safe)
    return left.join(renamed, condition, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Keys, null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``."""
    pairs = _pairs(on)
    renamed, condition, keys = _prepare(left, right.select(*[r for _, r in pairs]), on, null_safe)
    return left.join(renamed, condition, "left_anti")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only: ``(key, side)``."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return anti_join(l, r, key, null_safe=True).withColumn("side", F.lit("left")).unionByName(
        anti_join(r, l, key, null_safe=True).withColumn("side", F.lit("right"))
    )


def check_fan_out(left: DataFrame, right: DataFrame, on: Keys, limit: int) -> None:
    """Fail if one key of ``right`` stands for more than ``limit`` rows."""
    keys = [r for _, r in _pairs(on)]
    worst = right.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if worst is not None and worst > limit:
        raise ValueError(f"join on {keys} would repeat a row {worst} times, more than {limit}")


def with_group(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach aggregates of each row's group.

    Aggregate plus join rather than a window: partial aggregation runs before
    the shuffle, so a group holding a large part of the rows stays spread out.
    """
    return left_join(df, df.groupBy(*by).agg(*aggs), list(by))


def one_row(stats: DataFrame) -> Column:
    """The only row of ``stats`` as a struct column: a scalar subquery, not a join."""
    return stats.select(F.struct(*stats.columns).alias("row")).scalar()


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_fill(*dfs: DataFrame) -> DataFrame:
    """Union by name; a column absent on one side is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*right.columns).subtract(right)
