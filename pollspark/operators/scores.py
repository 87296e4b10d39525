"""Latent scores: walks, poststratification, item parameters, likelihood, prior."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark.functions.columns import ordered_logit, param_index, param_name
from pollspark.operators.aggregate import geo_mean
from pollspark.operators.ranking import row_numbers
from pollspark.operators.relate import inner_join, left_join, union_all, union_distinct

LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)

# Scale of the first step of each walk, and the priors of the model.
COUNTRY_START_SD, REGION_START_SD = 5.0, 3.0
COUNTRY_STEP_PRIOR, REGION_STEP_PRIOR = (2.0, 8.0), (1.0, 8.0)
GAMMA_PRIOR = (1.0, 0.55)
UNUSED_OFFSET = 100


def region_scores(
    country_walk: DataFrame, region_effect: DataFrame, regions: DataFrame, time: Sequence[str] = ("year_int",)
) -> DataFrame:
    """Country walk plus region effect, per period (and draw, if in ``time``).

    ``country_walk``: iso_3166, *time, country_alpha. ``region_effect``:
    mergekey, *time, region_effect. ``regions``: mergekey, iso_3166.
    """
    placed = inner_join(region_effect, regions, ["mergekey"])
    joined = inner_join(placed, country_walk, ["iso_3166", *time])
    return joined.withColumn("region_alpha", F.col("country_alpha") + F.col("region_effect"))


def poststratify(
    region: DataFrame,
    weights: DataFrame,
    score: str,
    time: Sequence[str] = ("year_int",),
    renormalise: bool = False,
    name: str = "country_poststrat",
) -> DataFrame:
    """Weighted sum of region scores by country and period.

    ``renormalise`` divides by the weight present, for tables where some regions
    have no score.
    """
    joined = inner_join(region, weights.select("mergekey", "wt"), ["mergekey"])
    total: Column = F.sum(F.col(score) * F.col("wt"))
    if renormalise:
        total = F.try_divide(total, F.sum(F.when(F.col(score).isNotNull(), F.col("wt"))))
    return joined.groupBy("iso_3166", *time).agg(total.alias(name))


def centre_cutpoints(raw: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adjust raw cutpoints for the number of options and centre them.

    ``raw``: question, k, beta_raw. The mean over questions of the mean used
    cutpoint becomes 0; unused cutpoints are shifted along and flagged.
    """
    kmin1 = F.col("kmin1")
    slope = F.when(kmin1 != 1, kmin1 - 1).otherwise(1)
    joined = inner_join(raw, thresholds, ["question"])
    loose = joined.withColumn("beta_uncentered", (2 * F.col("beta_raw") - (kmin1 + 1)) / slope).withColumn(
        "used", F.col("k") <= kmin1
    )
    middle = loose.where("used").groupBy("question").agg(F.avg("beta_uncentered").alias("m"))
    centre = middle.agg(F.avg("m").alias("mean_beta_mid")).scalar()
    return loose.withColumn("beta", F.col("beta_uncentered") - centre)


def scale_discrimination(raw: DataFrame) -> DataFrame:
    """Divide by the geometric mean so that the product over questions is 1."""
    centre = raw.agg(geo_mean("gamma_raw").alias("g")).scalar()
    return raw.withColumn("gamma", F.col("gamma_raw") / centre)


def cell_probabilities(
    cells: DataFrame, scores: DataFrame, score: str, on: Sequence[str], gamma: DataFrame, beta: DataFrame
) -> DataFrame:
    """Log probability ``ll`` of each cell's option. ``gamma``: question, gamma, kmin1.
    ``beta``: question, k, beta (used cutpoints)."""
    cuts = beta.groupBy("question").agg(
        F.map_from_entries(F.array_agg(F.struct(F.col("k").cast("int"), "beta"))).alias("cuts")
    )
    items = inner_join(gamma.select("question", "gamma", "kmin1"), cuts, ["question"])
    joined = inner_join(inner_join(cells, items, ["question"]), scores.select(*on, score), list(on))
    g, option = F.col("gamma"), F.col("option").cast("int")
    lower = g * F.try_element_at("cuts", option - 1)
    upper = g * F.try_element_at("cuts", option)
    return joined.withColumn("ll", ordered_logit(option, F.col("kmin1"), g * F.col(score), lower, upper)).drop("cuts")


def ordinal_loglik(
    cells: DataFrame, scores: DataFrame, score: str, on: Sequence[str], gamma: DataFrame, beta: DataFrame
) -> DataFrame:
    """Count-weighted log-likelihood of all cells, one row."""
    per_cell = cell_probabilities(cells, scores, score, on, gamma, beta)
    return per_cell.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("yes") * F.col("ll")).alias("loglik"))


def _normal_lpdf(x: Column, mu: Column | float, sd: Column | float) -> Column:
    z = (x - mu) / sd
    return -0.5 * z * z - F.ln(F.lit(sd) if isinstance(sd, (int, float)) else sd) - LOG_SQRT_2PI


def _gamma_lpdf(x: Column, shape: float, rate: float) -> Column:
    return shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * F.ln(x) - rate * x


def log_prior(
    country_steps: DataFrame,
    region_steps: DataFrame,
    step_sizes: DataFrame,
    gamma_raw: DataFrame,
    beta_raw: DataFrame,
    thresholds: DataFrame,
) -> DataFrame:
    """Log prior density by block: ``(block, log_prior)``.

    ``country_steps`` and ``region_steps``: year_int, step (raw steps).
    ``step_sizes``: country_step, region_step, one row.
    """
    blocks = []
    for name, steps, start in (
        ("country_steps", country_steps, COUNTRY_START_SD),
        ("region_steps", region_steps, REGION_START_SD),
    ):
        sd = F.when(F.col("year_int") == 1, start).otherwise(1.0)
        blocks.append((name, steps.select(_normal_lpdf(F.col("step"), 0.0, sd).alias("lp"))))
    blocks.append(("country_step", step_sizes.select(_gamma_lpdf(F.col("country_step"), *COUNTRY_STEP_PRIOR).alias("lp"))))
    blocks.append(("region_step", step_sizes.select(_gamma_lpdf(F.col("region_step"), *REGION_STEP_PRIOR).alias("lp"))))
    blocks.append(("gamma_raw", gamma_raw.select(_gamma_lpdf(F.col("gamma_raw"), *GAMMA_PRIOR).alias("lp"))))
    kmin1 = F.col("kmin1")
    slope = F.when(kmin1 != 1, kmin1 - 1).otherwise(1).cast("double")
    mean = F.col("k") + F.when(F.col("k") > kmin1, UNUSED_OFFSET).otherwise(0)
    cut = inner_join(beta_raw, thresholds, ["question"])
    blocks.append(("beta_raw", cut.select(_normal_lpdf(F.col("beta_raw"), mean, slope).alias("lp"))))
    summed = [df.agg(F.sum("lp").alias("log_prior")).select(F.lit(name).alias("block"), "log_prior") for name, df in blocks]
    return union_all(*summed)


def decode_indices(summary: DataFrame, parameter: str) -> DataFrame:
    """Rows of one parameter with its integer indices ``i`` and ``j``."""
    named = summary.withColumn("parameter", param_name("variable")).where(F.col("parameter") == parameter)
    return named.withColumn("i", param_index("variable", 1)).withColumn("j", param_index("variable", 2))


def decode_region(summary: DataFrame, regions: DataFrame, periods: DataFrame, parameter: str = "region_alpha") -> DataFrame:
    """Region estimates with names. ``regions``: regioncode_int, mergekey, iso_3166;
    ``periods``: year_int, year2."""
    decoded = decode_indices(summary, parameter)
    return left_join(left_join(decoded, regions, [("i", "regioncode_int")]), periods, [("j", "year_int")])


def decode_country(
    summary: DataFrame, countries: DataFrame, periods: DataFrame, parameter: str = "country_poststrat"
) -> DataFrame:
    """Country estimates with names, de-duplicated. ``countries``: iso_3166_int, iso_3166."""
    decoded = decode_indices(summary, parameter)
    named = left_join(left_join(decoded, countries, [("i", "iso_3166_int")]), periods, [("j", "year_int")])
    return named.distinct()


def decode_question(summary: DataFrame, questions: DataFrame, parameter: str = "gamma") -> DataFrame:
    """Discriminations with question names. ``questions``: question_int, question."""
    return left_join(decode_indices(summary, parameter).drop("j"), questions, [("i", "question_int")])


def decode_cutpoints(summary: DataFrame, cells: DataFrame, sequence: bool = False) -> DataFrame:
    """Cutpoints with question and option, used ones only.

    ``cells``: question_int, option. In the sequence form the variables carry one
    running index and are numbered 1..n inside each question in code order.
    """
    limits = cells.groupBy("question_int").agg((F.max("option") - 1).cast("int").alias("n_used"))
    decoded = decode_indices(summary, "beta")
    if not sequence:
        placed = decoded.withColumnsRenamed({"i": "question_int", "j": "option"})
        kept = inner_join(placed, limits, ["question_int"])
        return kept.where(F.col("option") <= F.col("n_used")).drop("n_used")
    slots = limits.select("question_int", F.explode(F.sequence(F.lit(1), F.col("n_used"))).alias("option"))
    numbered = row_numbers(slots, [F.col("question_int"), F.col("option")], "i")
    return inner_join(decoded.drop("j"), numbered, ["i"])


def item_lookup(cells: DataFrame, nat: DataFrame, *cols: str) -> DataFrame:
    """Distinct lookup rows over regional and national cells."""
    return union_distinct(cells.select(*cols), nat.select(*cols))

