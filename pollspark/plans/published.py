"""Published tables that chain scaled estimates, outside series and regressions, each with its own scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.functions.columns import safe_ln
from pollspark.operators import regress as J
from pollspark.operators.periods import period_change, series_length
from pollspark.operators.relate import inner_join, left_join
from pollspark.operators.shape import extremes, pivot_wider, reorder, standardise
from pollspark.plans.reports import scale_estimates
from pollspark.session import materialise


def exposure_regression(est: DataFrame, exposure: DataFrame, periods: Sequence[str], last: str) -> DataFrame:
    """Standardised score on standardised exposure, in the ``last`` period.

    ``est``: iso_3166, year2, mean over all periods; scores are standardised over all of
    them, exposure over the rows of ``periods``. ``exposure``: iso_3166, exposure.
    """
    scaled = scale_estimates(est).where(F.col("year2").isin(*periods)).select("iso_3166", "year2", "mean_std")
    joined = standardise(left_join(scaled, exposure, "iso_3166"), "exposure", name="exp_std")
    return J.ols_robust(joined.where(F.col("year2") == last), "mean_std", "exp_std")


def emissions_regression(regions: DataFrame, per_head: DataFrame, continent: str, period: str) -> DataFrame:
    """Scores on logarithms of emissions per head in one continent and period, clustered by country.

    Both are standardised inside that scope: all its regions for the scores, those with
    emissions for the logarithms. ``regions``: iso_3166, mergekey, continent_name, year2,
    mean. ``per_head``: mergekey, percap.
    """
    inside = regions.where((F.col("continent_name") == continent) & (F.col("year2") == period))
    joined = left_join(inside, per_head.select("mergekey", safe_ln("percap").alias("percap_ln")), "mergekey")
    scaled = standardise(standardise(materialise(joined), "mean", name="mean_std"), "percap_ln", name="percap_ln_std")
    return J.ols_cluster(scaled, "mean_std", "percap_ln_std", "iso_3166")


def long_series_means(means: DataFrame, min_periods: int = 3) -> DataFrame:
    """``(question, iso_3166, year2, yes_scl, n)`` of questions asked in at least ``min_periods`` periods.

    ``means``: question, iso_3166, year2, yes, size; cells without answers are left out
    and means standardised inside the question. ``n`` is the number of periods.
    """
    asked = means.where(F.col("size") != 0)
    kept = series_length(asked, "question", "year2").where(F.col("n") >= min_periods)
    joined = inner_join(asked, kept, ["question"])
    return standardise(joined, "yes", ["question"], "yes_scl").select("question", "iso_3166", "year2", "yes_scl", "n")


def series_prediction(series: DataFrame, est: DataFrame, disc: DataFrame) -> DataFrame:
    """How well the scores predict each long series inside countries, strongest discrimination first.

    ``series``: ``long_series_means``. ``est``: iso_3166, year2, mean. ``disc``: question, discrimination.
    """
    scored = left_join(series, est.select("iso_3166", "year2", "mean"), ["iso_3166", "year2"])
    share = J.partial_r2(scored, "yes_scl", "mean", "iso_3166", ["question"]).select("question", "partial_r2")
    asked = series.groupBy("question").agg(F.max("n").alias("periods_asked"))
    joined = left_join(left_join(asked, share, "question"), disc.select("question", "discrimination"), "question")
    return joined.select("question", "periods_asked", "partial_r2", "discrimination").orderBy(F.desc("discrimination"), "question")


def series_pairs(series: DataFrame, questions: Sequence[str], min_df: int = 10) -> DataFrame:
    """How well each long series predicts each earlier one inside countries."""
    wide = pivot_wider(series, ["iso_3166", "year2"], "question", "yes_scl", questions)
    return J.pairwise_partial_r2(wide, questions, "iso_3166", min_df)


def extreme_changes(est: DataFrame, first: str, last: str, n: int = 10) -> DataFrame:
    """The countries whose 0-1 score rose and fell most between two periods, ranked by the change.

    ``est``: iso_3166, year2, mean_scl. A country without one of the periods has no change and is left out.
    """
    changed = period_change(est, "iso_3166", "year2", "mean_scl", first, last)
    ends = materialise(extremes(changed, "delta", n, "iso_3166"))
    return reorder(ends, "iso_3166", "delta", "place")


def with_obs(est: DataFrame, obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observation counts attached, 0 where there are none."""
    return left_join(est, obs.select(*keys, "obs"), list(keys)).withColumn("obs", F.coalesce("obs", F.lit(0)))
