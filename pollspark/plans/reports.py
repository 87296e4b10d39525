"""Published tables, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark.functions import columns as C
from pollspark.operators.aggregate import (
    correlation,
    n_unique,
    regional_cv,
    samples,
    tally,
    validation_corr,
)
from pollspark.operators.periods import apply_interpolation, flag_drift, interpolate
from pollspark.operators.ranking import median, quantiles
from pollspark.operators.regress import near_average_items, partial_r2
from pollspark.operators.relate import inner_join, left_join, one_row, semi_join
from pollspark.operators.shape import NOISE, extremes, half_groups, reorder, standardise
from pollspark.session import materialise

# Continent groups of the interval tables.
CONTINENT_GROUPS = {
    "North America": "Americas",
    "South America": "Americas",
    "Asia": "Asia, Oceania",
    "Oceania": "Asia, Oceania",
    "Europe": "Europe, Eurasia",
    "Eurasia": "Europe, Eurasia",
    "Africa": "Africa",
}
# Countries of the coefficient-of-variation and quotient tables.
LARGEST_SAMPLES = ("US", "DE", "GB", "FR", "IN", "CN", "ES", "IT", "PL", "NL", "FI", "SE", "MX", "HU", "CZ")
QUOTIENT_COUNTRIES = ("US", "CN", "IN")
QUOTIENT_EXCLUDED = ("CN-HK",)
# Countries answered in surveys but not scored.
UNSCORED_CONTINENTS = {"AO": "Africa", "XK": "Europe"}


def scale_estimates(est: DataFrame, score: str = "mean") -> DataFrame:
    """Standardised and 0-1 scores over the whole table, both binned.

    The same columns as ``standardise`` and ``rescale01``, from one aggregate row.
    """
    value = C.finite(score)
    sd, noise = F.stddev_samp(score), F.lit(NOISE) * F.max(F.abs(F.col(score)))
    stats = est.agg(
        F.avg(score).alias("mu"), F.when(sd > noise, sd).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    row = {c: F.col(f"__s.{c}") for c in stats.columns}
    scaled = est.withColumn("__s", one_row(stats)).withColumns(
        {
            "mean_std": F.when(row["sd"] > 0, (F.col(score) - row["mu"]) / row["sd"]),
            "mean_scl": F.try_divide(F.col(score) - row["lo"], row["hi"] - row["lo"]),
        }
    )
    return scaled.drop("__s").withColumns(
        {
            "mean_std_bin": C.cut("mean_std", C.STD_BREAKS, C.STD_LABELS),
            "mean_scl_bin": C.cut("mean_scl", C.SCL_BREAKS, C.SCL_LABELS),
        }
    )


def clean_estimates(
    est: DataFrame, obs: DataFrame, nat: DataFrame, final: str, end: int, tol: float = 0.1
) -> DataFrame:
    """The cleaning stage: observation counts attached (0 for none), drifting regions
    interpolated after their last data, then scaled and binned.

    ``est``: iso_3166, mergekey, year2, mean. ``obs``: mergekey, year2, obs. ``nat``:
    iso_3166, year2, mean. The regional rows are read four times, hence written once.
    """
    counted = left_join(est, obs.select("mergekey", "year2", "obs"), ["mergekey", "year2"])
    counted = materialise(counted.withColumn("obs", F.coalesce("obs", F.lit(0))))
    lines = interpolate(flag_drift(counted, nat, final, tol), end)
    return scale_estimates(apply_interpolation(counted, lines).drop("mean_interp"))


def export_periods(est: DataFrame, period: str, first: str, last: str) -> DataFrame:
    return est.where(F.col(period).isin(first, last))


def validation_table(
    stats: DataFrame, est: DataFrame, disc: DataFrame, kept: DataFrame, extra: DataFrame | None = None
) -> DataFrame:
    """Mean raw response beside the model score, per question, source, country and period.

    ``stats``: ``answer_stats`` by source2, iso_3166 and year2. ``est``: iso_3166,
    year2, mean, continent_name. ``disc``: question, discrimination. ``kept``:
    question list. ``extra``: prepared rows of sources that cannot be shared.
    """
    both = stats.where(F.col("size") != 0)
    if extra is not None:
        both = both.unionByName(extra, allowMissingColumns=True)
    scored = left_join(both, est.select("iso_3166", "year2", "mean", "continent_name"), ["iso_3166", "year2"])
    return semi_join(left_join(scored, disc.select("question", "discrimination"), "question"), kept, "question")


def with_unscored_continents(table: DataFrame) -> DataFrame:
    """The continents of unscored countries, filled in for the published table only.

    Panels are scaled and plotted before: an unscored country has no panel there.
    """
    known = C.recode("iso_3166", UNSCORED_CONTINENTS, F.lit(None).cast("string"))
    return table.withColumn("continent_name", F.coalesce("continent_name", known))


def with_correlations(val: DataFrame) -> DataFrame:
    """Validation rows with the response scaled inside its panel and the
    correlation of its question and period (more than one country).

    The rows are country sized and read four times, hence written once."""
    val = materialise(val)
    corr = validation_corr(val.where(F.col("mean").isNotNull()), "avg_resp", "mean", ["question", "year2"], "iso_3166")
    panel = ["question", "year2", "source2", "discrimination", "continent_name"]
    scaled = standardise(val.select(*panel, "iso_3166", "mean", "avg_resp"), "avg_resp", panel, "prop_scl")
    return left_join(scaled, corr, ["question", "year2"]).where(F.col("ncountries") > 1)


def corr_points(points: DataFrame, qlist: DataFrame, near_average: bool = False, disc: DataFrame | None = None) -> DataFrame:
    """Plot-ready rows of kept question-sources, questions ranked by median correlation
    (by discrimination for the near-average variant)."""
    keyed = points.withColumn("qsource", C.paste("-", "question", "source2"))
    kept = semi_join(keyed, qlist, "qsource").where(F.col("discrimination").isNotNull())
    kept = kept.where(F.col("continent_name").isNotNull())
    order = "corr"
    if near_average:
        kept = semi_join(kept, near_average_items(disc, "discrimination"), "question")
        order = "discrimination"
    # The ranking reads the points three times.
    ranked = reorder(materialise(kept), "question", order, "question_rank")
    return ranked.withColumn("discrimination", F.bround("discrimination", 2))


def compare_national(est: DataFrame, outside: DataFrame, iso: str) -> DataFrame:
    """One country's series beside the biennial median of an outside series, with their correlation.

    ``outside``: year, concern."""
    labelled = outside.withColumn("year2", C.biennium("year")).where(F.col("year2").isNotNull())
    other = median(labelled, "concern", ["year2"], "outside")
    points = left_join(est.where(F.col("iso_3166") == iso).select("year2", "mean"), other, "year2")
    total = points.agg(correlation("mean", "outside").alias("c")).scalar()
    return points.withColumn("corr", F.bround(total, 2))


def compare_subnational(
    est: DataFrame, outside: DataFrame, iso: str, sep: str = "-", collapse: str = "2yr"
) -> DataFrame:
    """One country's regions beside an outside series by period, with the correlation per period.

    ``est``: iso_3166, mergekey, year2, mean, mean_scl. ``outside``: abb, year, concern.
    """
    if collapse == "5yr":
        labelled = outside.withColumn("year2", C.five_year("year"))
        other = labelled.groupBy("year2", "abb").agg(F.avg("concern").alias("outside"))
    else:
        labelled = outside.withColumn("year2", C.biennium("year"))
        other = median(labelled, "concern", ["year2", "abb"], "outside")
    abb = C.split_label("mergekey", sep, 2, merge=False)[1]
    regions = est.where(F.col("iso_3166") == iso).withColumn("abb", abb).select("abb", "year2", "mean", "mean_scl")
    points = left_join(regions, other, ["abb", "year2"])
    seen = points.where(F.col("outside").isNotNull())
    corr = seen.groupBy("year2").agg(F.bround(correlation("mean", "outside"), 2).alias("corr"))
    return left_join(points, corr, "year2")


def subnational_partial_r2(points: DataFrame) -> DataFrame:
    return partial_r2(points, "mean_scl", "outside", "abb")


def web_export(key: DataFrame, nat: DataFrame, reg: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Published regions with regional and national score per period, one row each.

    A region whose country has no score keeps its row with missing scores.
    ``key``: iso_3166, mergekey and any further columns.
    """
    ids = key.columns
    national = nat.where(F.col("year2").isin(*periods)).select("iso_3166", "year2", F.col("mean_scl").alias("national"))
    regional = reg.select("mergekey", "year2", F.col("mean_scl").alias("regional"))
    joined = left_join(left_join(key, national, "iso_3166"), regional, ["mergekey", "year2"])
    columns = []
    for p in periods:
        for level in ("regional", "national"):
            columns.append(F.max(F.when(F.col("year2") == p, F.col(level))).alias(f"mean_scl_{level}_{p}"))
    return joined.groupBy(*ids).agg(*columns)


def map_table(shapes: DataFrame, est: DataFrame, key: str, periods: Sequence[str], score: str = "mean_std") -> DataFrame:
    """Shapes with estimates; a shape without any is repeated for each period."""
    joined = left_join(shapes, est, key)
    scored = joined.where(F.col(score).isNotNull())
    empty = joined.where(F.col(score).isNull()).drop("year2")
    repeated = empty.withColumn("year2", F.explode(F.array(*[F.lit(p) for p in periods])))
    return scored.unionByName(repeated)


def region_window(table: DataFrame, continents: Sequence[str], period: str) -> DataFrame:
    """Continents of one map window; shapes without continent count as ``Missing``."""
    named = table.withColumn("continent_name", F.coalesce("continent_name", F.lit("Missing")))
    return named.where(F.col("continent_name").isin(*continents, "Missing") & (F.col("year2") == period))


def interval_table(est: DataFrame, n: int, label: Sequence[str], key: str, by: Sequence[str] = ()) -> DataFrame:
    """Top and bottom regions with their interval, labelled and ranked by score."""
    ends = materialise(extremes(est.distinct(), "mean", n, key, by))
    return reorder(ends.withColumn("fullname", C.paste(", ", *label)), "fullname", "mean", "place")


def continent_group(col: str = "continent_name") -> Column:
    return C.recode(col, CONTINENT_GROUPS)


def country_intervals(est: DataFrame, key: str = "iso_3166") -> DataFrame:
    """All countries ranked by score, split into two columns of a figure."""
    return half_groups(est, [F.col("mean"), F.col(key)], "column")


def trend_bands(country: DataFrame, names: DataFrame) -> DataFrame:
    bands = left_join(country.select("iso_3166", "year2", "mean", "q5", "q95"), names, "iso_3166")
    return bands.orderBy("iso_3166", "year2")


def coverage_tally(cells: DataFrame, drop: Sequence[str] = ("regioncode_int", "size", "yes")) -> DataFrame:
    """Distinct cells left after dropping the named columns, per period and country."""
    return tally(cells.drop(*drop).distinct(), "year2", "iso_3166", "continent_name")


def item_table(disc: DataFrame) -> DataFrame:
    """Discriminations with item category, short name and rank."""
    fixed = disc.withColumn("question", C.recode("question", {"attribution2_eurobarometer": "attribution_eurobarometer2"}))
    category, short = C.split_label("question", "_", 2)
    return reorder(fixed, "question", "mean", "place").withColumns({"category": category, "short": short})


def item_quartiles(disc: DataFrame) -> DataFrame:
    return quantiles(disc, "mean", [0, 0.25, 0.5, 0.75, 1], names=["q0", "q25", "q50", "q75", "q100"])


def sampled_regions(
    reg: DataFrame, cells: DataFrame, min_n: int = 999, excluded: Sequence[str] = QUOTIENT_EXCLUDED
) -> DataFrame:
    """Regions whose sample (sizes summed over options) exceeds ``min_n``."""
    joined = inner_join(reg, samples(cells, "mergekey"), ["mergekey"])
    return joined.where((F.col("n") > min_n) & ~F.col("mergekey").isin(*excluded))


def location_quotient(regions: DataFrame, nat: DataFrame) -> DataFrame:
    """Regional score as a percentage of the national one."""
    national = nat.select("iso_3166", F.col("mean_scl").alias("nat_mean_scl"))
    joined = inner_join(regions, national, ["iso_3166"])
    return joined.withColumn("reg_ratio", F.try_divide("mean_scl", "nat_mean_scl") * 100)


def quotient_extremes(quotients: DataFrame, countries: Sequence[str] = QUOTIENT_COUNTRIES, n: int = 5) -> DataFrame:
    chosen = quotients.where(F.col("iso_3166").isin(*countries)).select("mergekey", "iso_3166", "reg_ratio").distinct()
    return extremes(chosen, "reg_ratio", n, "mergekey", ["iso_3166"])


def cv_tables(
    regions: DataFrame, nat: DataFrame, cells: DataFrame, countries: Sequence[str] = LARGEST_SAMPLES, min_n: int = 25_000
) -> DataFrame:
    """Variation inside countries for a fixed list (``listed``) and for large samples (``sample``)."""
    spread = regional_cv(regions, ["iso_3166"], "mean_scl")
    named = inner_join(spread, nat.select("iso_3166", F.col("mean_scl").alias("nat_mean_scl")), ["iso_3166"])
    sized = left_join(named, samples(cells, "iso_3166"), "iso_3166")
    fixed = sized.where(F.col("iso_3166").isin(*countries)).withColumn("table", F.lit("listed"))
    large = sized.where((F.col("n") > min_n) & F.col("nat_cv").isNotNull()).withColumn("table", F.lit("sample"))
    return fixed.unionByName(large).orderBy("table", F.desc("nat_cv"), "iso_3166")


def respondent_counts(answers: DataFrame, questions: Sequence[str], constructed: str) -> DataFrame:
    """Respondents and respondents with an answer by construction code, from one scan."""
    return answers.groupBy(F.col(constructed).cast("string").alias(constructed)).agg(
        F.count(F.lit(1)).alias("respondents"), F.count_if(_answered(questions)).alias("answered")
    )


def _answered(questions: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(q).isNotNull() for q in questions])


def full_sample(answers: DataFrame, questions: Sequence[str], withheld: DataFrame) -> DataFrame:
    """One row: respondents with an answer, rows that may not be shared, and both together.

    ``withheld`` has a row for each respondent whose answers are not in ``answers``.
    """
    here = answers.agg(F.count_if(_answered(questions)).alias("shared"))
    rows = withheld.agg(F.count(F.lit(1)).alias("withheld"))
    return here.withColumn("withheld", rows.scalar()).withColumn("total", F.col("shared") + F.col("withheld"))


def place_counts(cells: DataFrame) -> DataFrame:
    """Countries and regions, the latter without national keys (pattern ``.nat``)."""
    split = cells.select("iso_3166", F.when(~F.col("mergekey").rlike(".nat"), F.col("mergekey")).alias("mergekey"))
    return n_unique(split, "iso_3166", "mergekey")
