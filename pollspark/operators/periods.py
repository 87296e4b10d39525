"""Change between periods, drift after the last data, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.functions.columns import biennium, direction
from pollspark.operators.aggregate import tally
from pollspark.operators.relate import left_join, semi_join
from pollspark.operators.shape import last_observed


def period_change(est: DataFrame, unit: str, period: str, score: str, first: str, last: str) -> DataFrame:
    """Score of two periods side by side, with change and direction."""
    wide = (
        est.where(F.col(period).isin(first, last))
        .groupBy(unit)
        .agg(
            F.max(F.when(F.col(period) == first, F.col(score))).alias("first"),
            F.max(F.when(F.col(period) == last, F.col(score))).alias("last"),
        )
    )
    changed = wide.withColumn("delta", F.col("last") - F.col("first"))
    return changed.withColumn("change", direction("delta"))


def direction_counts(change: DataFrame) -> DataFrame:
    return tally(change, "change")


def flag_drift(est_reg: DataFrame, est_nat: DataFrame, final: str, tol: float = 0.1) -> DataFrame:
    """Regions whose change since their last data departs from the nation's.

    ``toobig`` is 1 if the signs differ and the gap exceeds ``tol``, or the signs
    agree and the region moved further than the nation by more than ``tol``.
    Tables need ``iso_3166, year2, mean`` (regional also ``mergekey, obs``).
    """
    last = last_observed(est_reg.select("mergekey", "iso_3166", "year2", "mean", "obs"), "mergekey", "year2", final)
    last = last.select("iso_3166", "mergekey", "year2", F.col("mean").alias("reg_mean"))
    nat = est_nat.select("iso_3166", "year2", F.col("mean").alias("nat_mean"))
    reg_end = est_reg.where(F.col("year2") == final).select("mergekey", F.col("mean").alias("reg_end"))
    nat_end = est_nat.where(F.col("year2") == final).select("iso_3166", F.col("mean").alias("nat_end"))
    joined = left_join(last, nat, ["iso_3166", "year2"])
    joined = left_join(left_join(joined, reg_end, "mergekey"), nat_end, "iso_3166")
    d_nat, d_reg = F.col("delta_nat"), F.col("delta_reg")
    gap = F.col("diff_deltas")
    away = (F.abs(gap) > tol) & (F.signum(d_reg) != F.signum(d_nat))
    over = (d_reg > 0) & (d_nat > 0) & (gap > tol)
    under = (d_reg < 0) & (d_nat < 0) & (gap < -tol)
    return (
        joined.withColumn("delta_nat", F.col("nat_end") - F.col("nat_mean"))
        .withColumn("delta_reg", F.col("reg_end") - F.col("reg_mean"))
        .withColumn("diff_deltas", d_reg - d_nat)
        .withColumn("toobig", F.when(gap.isNull(), None).otherwise((away | over | under).cast("int")))
    )


def interpolate(flagged: DataFrame, end: int, step: int = 2) -> DataFrame:
    """Straight line for flagged regions from the last data year to ``end``,
    where the region ends with the nation's change: ``(mergekey, year2, mean_interp, later)``.

    ``later`` marks the periods after the last data. A region with data up to ``end``
    or after it needs no line.
    """
    start = F.substring("year2", 1, 4).cast("int")
    years = F.when(start < end, F.sequence(start, F.greatest(start, F.lit(end)), F.lit(step)))
    lines = flagged.where(F.col("toobig") == 1).select(
        "mergekey", "reg_mean", "delta_nat", start.alias("y0"), F.explode(years).alias("year")
    )
    share = F.try_divide(F.col("year") - F.col("y0"), F.lit(end) - F.col("y0"))
    return lines.select(
        "mergekey",
        biennium("year").alias("year2"),
        (F.col("reg_mean") + F.col("delta_nat") * share).alias("mean_interp"),
        (F.col("year") > F.col("y0")).alias("later"),
    )


def apply_interpolation(est: DataFrame, interp: DataFrame) -> DataFrame:
    """Replace scores after the last data by their interpolated value, and flag them.

    The line starts at the last observed score, so comparing values instead would
    depend on the order in which an average was added up.
    """
    joined = left_join(est, interp, ["mergekey", "year2"])
    flagged = joined.withColumn("interpolated", F.when(F.col("later"), 1).otherwise(0)).drop("later")
    return flagged.withColumn("mean", F.when(F.col("interpolated") == 1, F.col("mean_interp")).otherwise(F.col("mean")))


def series_length(df: DataFrame, question: str, period: str) -> DataFrame:
    """Number of periods in which each question was asked."""
    once = df.select(question, period).distinct()
    return once.groupBy(question).agg(F.count(period).alias("n"))


def long_series(df: DataFrame, question: str, period: str, min_periods: int = 3) -> DataFrame:
    """Rows of questions asked in at least ``min_periods`` periods."""
    kept = series_length(df, question, period).where(F.col("n") >= min_periods)
    return semi_join(df, kept, question)
