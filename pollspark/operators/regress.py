"""Regressions written as aggregates: slopes, robust and clustered errors, partial R2."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark.functions.columns import PER_HEAD_BREAKS, PER_HEAD_LABELS, cut, safe_ln
from pollspark.operators.aggregate import geo_mean
from pollspark.operators.dimension import item_pairs
from pollspark.operators.ranking import quantiles
from pollspark.operators.relate import left_join, one_row
from pollspark.operators.shape import NOISE, standardise
from pollspark.session import materialise

# Countries always labelled in the quadrant chart.
ALWAYS_LABELLED = ("United States", "China", "Brazil", "India", "Russia", "Japan", "Germany")
TONS_PER_KILOTON = 1000


def _pairs(df: DataFrame, y: str, x: str, *keep: str) -> DataFrame:
    """Complete pairs as ``__y, __x`` doubles."""
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return both.select(*keep, F.col(y).cast("double").alias("__y"), F.col(x).cast("double").alias("__x"))


def _kept_pairs(df: DataFrame, y: str, x: str, *keep: str) -> DataFrame:
    """Complete pairs, written once: a first pass gives the line, a second its residuals."""
    return materialise(_pairs(df, y, x, *keep))


def _carried(line: DataFrame) -> list[Column]:
    """The numbers of a one-row struct ``s``, kept through an aggregate."""
    return [F.max(f"s.{c}").alias(c) for c in line.columns]


def _line_stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg("__x").alias("mx"),
        F.avg("__y").alias("my"),
        F.regr_sxx("__y", "__x").alias("sxx"),
        F.regr_syy("__y", "__x").alias("syy"),
        F.regr_sxy("__y", "__x").alias("sxy"),
    ]


def ols_robust(df: DataFrame, y: str, x: str) -> DataFrame:
    """Simple regression with HC2 errors, R2, adjusted R2 and RMSE, one row.

    Two passes: the line from moments, then squared residuals weighted by
    leverage ``1/n + dx^2/Sxx``.
    """
    pairs = _kept_pairs(df, y, x)
    line = pairs.agg(*_line_stats()).withColumn("slope", F.try_divide("sxy", "sxx"))
    rows = pairs.withColumn("s", one_row(line))
    s = {c: F.col(f"s.{c}") for c in line.columns}
    dx = F.col("__x") - s["mx"]
    resid = F.col("__y") - s["my"] - s["slope"] * dx
    leverage = 1 / s["n"] + F.try_divide(dx * dx, s["sxx"])
    weighted = F.try_divide(resid * resid, 1 - leverage)
    # Influence of a row on the intercept and on the slope.
    on_slope = F.try_divide(dx, s["sxx"])
    on_intercept = 1 / s["n"] - s["mx"] * on_slope
    total = rows.agg(
        *_carried(line),
        F.sum(resid * resid).alias("rss"),
        F.sqrt(F.sum(on_slope * on_slope * weighted)).alias("slope_se"),
        F.sqrt(F.sum(on_intercept * on_intercept * weighted)).alias("intercept_se"),
    )
    r2 = 1 - F.try_divide(F.col("rss"), F.col("syy"))
    n = F.col("n")
    return total.select(
        "n",
        (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        "intercept_se",
        "slope",
        "slope_se",
        r2.alias("r2"),
        (1 - (1 - r2) * F.try_divide(n - 1, n - 2)).alias("adj_r2"),
        F.sqrt(F.try_divide(F.col("rss"), n - 2)).alias("rmse"),
    )


def ols_within(df: DataFrame, y: str, x: str, fe: str) -> DataFrame:
    """Slope of ``x`` beside dummies for ``fe``, with HC2 errors, one row.

    Leverage of a row is ``1/n_group + dx^2/Sxx`` with ``dx`` centred in the
    group. A row whose leverage is 1 has no HC2 weight; its residual is 0.
    """
    pairs = _kept_pairs(df, y, x, fe)
    groups = pairs.groupBy(fe).agg(*_line_stats())
    total = groups.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("sxx").alias("sxx"),
        F.sum("sxy").alias("sxy"),
    ).withColumn("slope", F.try_divide("sxy", "sxx"))
    centres = groups.select(fe, F.col("n").alias("ng"), "mx", "my")
    rows = left_join(pairs, centres, fe).withColumn("s", one_row(total))
    dx = F.col("__x") - F.col("mx")
    resid = F.col("__y") - F.col("my") - F.col("s.slope") * dx
    leverage = 1 / F.col("ng") + F.try_divide(dx * dx, F.col("s.sxx"))
    weighted = F.when(leverage < 1 - 1e-12, resid * resid / (1 - leverage)).otherwise(0.0)
    spread = F.sum(dx * dx * weighted)
    return rows.agg(*_carried(total), spread.alias("meat")).select(
        "n", "groups", "slope", F.try_divide(F.sqrt("meat"), F.col("sxx")).alias("slope_se")
    )


def ols_cluster(df: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """Simple regression with errors clustered by ``cluster``, one row.

    Scores are summed per cluster; the sandwich carries the factor
    ``G/(G-1) * (n-1)/(n-2)``. ``df`` of the t value is ``G - 1``.
    """
    pairs = _kept_pairs(df, y, x, cluster)
    line = pairs.agg(*_line_stats()).withColumn("slope", F.try_divide("sxy", "sxx"))
    rows = pairs.withColumn("s", one_row(line))
    dx = F.col("__x") - F.col("s.mx")
    resid = F.col("__y") - F.col("s.my") - F.col("s.slope") * dx
    on_slope = F.try_divide(dx, F.col("s.sxx"))
    on_intercept = 1 / F.col("s.n") - F.col("s.mx") * on_slope
    scores = rows.groupBy(cluster).agg(
        F.sum(on_slope * resid).alias("u"), F.sum(on_intercept * resid).alias("v")
    )
    scores = scores.withColumn("s", one_row(line))
    total = scores.agg(
        *_carried(line),
        F.count(F.lit(1)).alias("clusters"),
        F.sum(F.col("u") * F.col("u")).alias("uu"),
        F.sum(F.col("v") * F.col("v")).alias("vv"),
    )
    g, n = F.col("clusters"), F.col("n")
    factor = F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 2)
    named = total.select(
        "n",
        "clusters",
        (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        F.sqrt(F.col("vv") * factor).alias("intercept_se"),
        "slope",
        F.sqrt(F.col("uu") * factor).alias("slope_se"),
    )
    return named.withColumn("intercept_t", F.try_divide("intercept", "intercept_se")).withColumn(
        "slope_t", F.try_divide("slope", "slope_se")
    )


def coefficient_table(cluster_fit: DataFrame) -> DataFrame:
    """Term, estimate, error, t value and p value from ``ols_cluster``."""
    row = cluster_fit.first()
    table = []
    for term in ("intercept", "slope"):
        estimate, se, t = row[term], row[term + "_se"], row[term + "_t"]
        p = None if t is None else t_two_sided(t, row["clusters"] - 1)
        table.append((term, estimate, se, t, p))
    return cluster_fit.sparkSession.createDataFrame(
        table, "term string, estimate double, std_error double, t_value double, p_value double"
    )


def t_two_sided(t: float, df: int) -> float:
    """Two-sided tail probability of Student's t, from the incomplete beta function."""
    return _beta_cdf(df / (df + t * t), df / 2, 0.5)


def _beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Continued fraction, evaluated from the far end.
    value = 1.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1 + odd / (1 + even / value)
    return front / value


def partial_r2(df: DataFrame, y: str, x: str, fe: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of the variance of ``y`` left by ``fe`` that ``x`` explains, per ``by``.

    Sums of squares inside each ``fe`` group, added up: no dummies and no solver.
    """
    groups = _pairs(df, y, x, *by, fe).groupBy(*by, fe).agg(
        *_line_stats(), F.max(F.abs("__x")).alias("ax"), F.max(F.abs("__y")).alias("ay")
    )
    total = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), *_summed())
    return total.select(*by, "n", "groups", _share().alias("partial_r2"))


def _summed() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "sxx", "syy", "sxy")] + [F.max(c).alias(c) for c in ("ax", "ay")]


def _share() -> Column:
    """Squared correlation from summed squares; missing where either is rounding noise, whatever the units.

    Noise is a deviation of no more than ``NOISE`` times the greatest value, as in ``standardise``.
    """
    sxx, syy, sxy = (F.col(c) for c in ("sxx", "syy", "sxy"))
    varies = [s > F.col("n") * (NOISE * F.col(a)) * (NOISE * F.col(a)) for s, a in ((sxx, "ax"), (syy, "ay"))]
    return F.when(varies[0] & varies[1], (sxy / sxx) * (sxy / syy))


def pairwise_partial_r2(wide: DataFrame, items: Sequence[str], unit: str, min_df: int = 10) -> DataFrame:
    """Partial R2 of every pair of question series after ``unit`` effects.

    ``wide`` has one row per unit and period and one column per question. One scan:
    a row's pairs of present questions are added up per unit and pair before the
    shuffle, so no row is paired with another. Kept: more rows than units and
    ``df > min_df``; ``df = n - units - 1``.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in items])
    present = wide.select(unit, F.filter(entries, lambda e: e["value"].isNotNull()).alias("entries"))
    pairs = present.select(F.col(unit).alias("__unit"), item_pairs(F.col("entries")).alias("p")).select("__unit", "p.*")
    # The earlier question of a pair is explained by the later one.
    per_unit = pairs.where("name_a <> name_b").groupBy("__unit", F.col("name_b").alias("x"), F.col("name_a").alias("y")).agg(
        F.regr_count("a", "b").alias("n"),
        F.regr_sxx("a", "b").alias("sxx"),
        F.regr_syy("a", "b").alias("syy"),
        F.regr_sxy("a", "b").alias("sxy"),
        F.max(F.abs("b")).alias("ax"),
        F.max(F.abs("a")).alias("ay"),
    )
    total = per_unit.groupBy("x", "y").agg(F.count(F.lit(1)).alias("units"), F.max("n").alias("n_years"), *_summed())
    freedom = F.col("n") - F.col("units") - 1
    return total.where((F.col("n") > F.col("units")) & (freedom > min_df)).select(
        "x", "y", _share().alias("partial_r2"), freedom.alias("df"), "n_years"
    )


def fit_line(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Fitted line per facet."""
    total = _pairs(df, y, x, *by).groupBy(*by).agg(*_line_stats())
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    return total.select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def near_average_items(disc: DataFrame, col: str, tol: float = 0.1) -> DataFrame:
    """Items within ``tol`` of the geometric mean discrimination rounded to one digit."""
    centre = disc.agg(F.bround(geo_mean(col), 1).alias("g")).scalar()
    # The edges are rounded so that they are decimal numbers again.
    return (
        disc.withColumn("centre", centre)
        .where(F.col(col).between(F.bround(F.col("centre") - tol, 6), F.bround(F.col("centre") + tol, 6)))
        .drop("centre")
    )


def quadrants(
    df: DataFrame, x: str, y: str, label: str, always: Sequence[str] = ALWAYS_LABELLED
) -> DataFrame:
    """Rows in a corner of the quartile grid, plus listed labels, typed emitter or outlier."""
    df = materialise(df)
    qx = quantiles(df, x, [0.25, 0.75], names=["x1", "x3"])
    qy = quantiles(df, y, [0.25, 0.75], names=["y1", "y3"])
    marked = df.withColumn("__qx", one_row(qx)).withColumn("__qy", one_row(qy))
    out_x = (F.col(x) < F.col("__qx.x1")) | (F.col(x) > F.col("__qx.x3"))
    out_y = (F.col(y) < F.col("__qy.y1")) | (F.col(y) > F.col("__qy.y3"))
    listed = F.col(label).isin(*always)
    kept = marked.where((out_x & out_y) | listed).drop("__qx", "__qy")
    return kept.withColumn("type", F.when(listed, "emitter").otherwise("outlier"))


def emissions_per_capita(emissions: DataFrame, crosswalk: DataFrame, pop: DataFrame) -> DataFrame:
    """Emissions per head by region, binned, and with standardised logarithm.

    ``emissions``: code, country, sector-filtered yearly ``kilotons``;
    ``crosswalk``: code, mergekey; ``pop``: mergekey, region_pop. Zero emissions
    have no logarithm.
    """
    by_code = emissions.groupBy("code", "country").agg((F.sum("kilotons") * TONS_PER_KILOTON).alias("tons"))
    merged = left_join(by_code, crosswalk, "code")
    by_region = merged.groupBy("country", "mergekey").agg(F.sum("tons").alias("tons"))
    heads = left_join(by_region, pop, "mergekey")
    ratio = heads.withColumn("percap", F.try_divide("tons", "region_pop"))
    ratio = ratio.withColumn("percap_bin", cut("percap", PER_HEAD_BREAKS, PER_HEAD_LABELS))
    # One row per region, read for the moments and again for the rows.
    logged = materialise(ratio.withColumn("percap_ln", safe_ln("percap")))
    return standardise(logged, "percap_ln", name="percap_ln_std")

