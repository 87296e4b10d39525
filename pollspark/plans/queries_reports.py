"""Published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.functions import columns as C
from pollspark.operators.aggregate import answer_stats, question_coverage
from pollspark.operators.draws import summarise_draws
from pollspark.operators.relate import inner_join, left_join
from pollspark.operators.scores import decode_region, item_lookup
from pollspark.operators.shape import rescale01
from pollspark.plans import reports as K
from pollspark.plans.fixtures import FINAL, QUESTION_COLS, Survey, interval
from pollspark.plans.queries_model import _DRIFT, _LINES, fitted
from pollspark.plans.registry import query, r, rounded
from pollspark.session import materialise

PAIR = ("2002-03", FINAL)


def _bins(value: str, breaks, labels) -> str:
    cases = " ".join(
        f"WHEN {value} > {low} AND {value} <= {high} THEN '{label}'"
        for low, high, label in zip(breaks, breaks[1:], labels, strict=False)
    )
    return f"CASE {cases} END"


_STD, _SCL = _bins("mean_std", C.STD_BREAKS, C.STD_LABELS), _bins("mean_scl", C.SCL_BREAKS, C.SCL_LABELS)
_VALID = f"""c AS (SELECT source2, iso_3166, year2, question, count(answer) AS size, avg(CASE WHEN answer >= 0 THEN answer END) AS avg_resp
          FROM resp_long GROUP BY 1, 2, 3, 4 HAVING count(answer) <> 0),
    kept AS (SELECT question, source2, concat(question, '-', source2) AS qsource FROM c GROUP BY 1, 2 HAVING count(DISTINCT iso_3166) >= 20),
    val AS (SELECT c.*, n.mean, k.continent_name, d.discrimination FROM c
            LEFT JOIN est_nat n ON c.iso_3166 = n.iso_3166 AND c.year2 = n.year2
            LEFT JOIN continents k ON n.iso_3166 = k.iso_3166 LEFT JOIN disc d ON c.question = d.question
            WHERE c.question IN (SELECT question FROM kept)),
    cor AS (SELECT question, year2, count(DISTINCT iso_3166) AS ncountries,
                   CASE WHEN count(*) = count(avg_resp) THEN round_even(corr(avg_resp, mean), 2) + 0.0E0 END AS corr
            FROM val WHERE mean IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT iso_3166) > 1),
    pts AS (SELECT v.question, v.year2, source2, discrimination, continent_name, iso_3166, mean, ncountries, corr,
                   CASE WHEN stddev_samp(avg_resp) OVER g > 1e-12
                        THEN (avg_resp - avg(avg_resp) OVER g) / stddev_samp(avg_resp) OVER g END AS prop_scl
            FROM val v JOIN cor ON v.question = cor.question AND v.year2 = cor.year2
            WINDOW g AS (PARTITION BY v.question, v.year2, source2, discrimination, continent_name))"""


def _stats(s: Survey) -> DataFrame:
    return materialise(answer_stats(s.wide, ["source2", "iso_3166", "year2"], QUESTION_COLS))


def _coverage(stats: DataFrame) -> DataFrame:
    found = question_coverage(stats, ["question", "source2"], "iso_3166", 20)
    return found.withColumn("qsource", C.paste("-", "question", "source2"))


def _disc(s: Survey) -> DataFrame:
    name = F.concat(F.lit("q_"), F.lower("question"))
    return s.item_gamma.select(name.alias("question"), F.col("gamma_raw").alias("discrimination"))


def _points(s: Survey, stats: DataFrame) -> DataFrame:
    est = left_join(s.est_nat, s.continents, "iso_3166")
    return K.with_correlations(K.validation_table(stats, est, _disc(s), _coverage(stats)))


@query(
    "k1_validation_table",
    f"""WITH {_VALID} SELECT question, year2, source2, {r("discrimination")} AS discrimination, continent_name, iso_3166,
               {r("mean")} AS mean, ncountries, corr, {r("prop_scl")} AS prop_scl FROM pts""",
)
def _(s: Survey) -> DataFrame:
    cols = ["question", "year2", "source2", "discrimination", "continent_name", "iso_3166", "mean", "ncountries", "corr", "prop_scl"]
    return rounded(K.with_unscored_continents(_points(s, _stats(s))).select(*cols), "discrimination", "mean", "prop_scl")


_RANKED = """o AS (SELECT question, row_number() OVER (ORDER BY median({by}) NULLS LAST, question) AS question_rank FROM f GROUP BY 1)
    SELECT f.question, year2, source2, iso_3166, round_even(discrimination, 2) AS discrimination, corr, question_rank
    FROM f JOIN o ON f.question = o.question"""
_POINT_COLS = ["question", "year2", "source2", "iso_3166", "discrimination", "corr", "question_rank"]


@query(
    "k2_correlation_points",
    f"""WITH {_VALID}, f AS (SELECT * FROM pts WHERE concat(question, '-', source2) IN (SELECT qsource FROM kept)
        AND discrimination IS NOT NULL AND continent_name IS NOT NULL), {_RANKED.format(by="corr")}""",
)
def _(s: Survey) -> DataFrame:
    stats = _stats(s)
    return K.corr_points(_points(s, stats), _coverage(stats)).select(*_POINT_COLS)


@query(
    "k2_near_average_points",
    f"""WITH {_VALID}, m AS (SELECT round_even(exp(avg(ln(discrimination))), 1) AS g FROM disc),
        f AS (SELECT pts.* FROM pts, m WHERE concat(question, '-', source2) IN (SELECT qsource FROM kept)
        AND discrimination BETWEEN round(g - 0.1E0, 6) AND round(g + 0.1E0, 6) AND continent_name IS NOT NULL),
        {_RANKED.format(by="discrimination")}""",
)
def _(s: Survey) -> DataFrame:
    stats = _stats(s)
    points = K.corr_points(_points(s, stats), _coverage(stats), near_average=True, disc=_disc(s))
    return points.select(*_POINT_COLS)


@query(
    "k3_national_comparison",
    f"""WITH o AS (SELECT concat(CAST(year - year % 2 AS VARCHAR), '-', lpad(CAST((year - year % 2 + 1) % 100 AS VARCHAR), 2, '0')) AS year2,
                          median(concern) AS outside FROM outside WHERE iso_3166 = 'NATION_1' AND year BETWEEN 2002 AND 2023 GROUP BY 1),
        j AS (SELECT n.year2, n.mean, o.outside FROM est_nat n LEFT JOIN o ON n.year2 = o.year2 WHERE n.iso_3166 = 'NATION_1')
        SELECT year2, {r("mean")} AS mean, {r("outside", 4)} AS outside, (SELECT round_even(corr(mean, outside), 2) + 0.0E0 FROM j) AS corr FROM j""",
)
def _(s: Survey) -> DataFrame:
    other = materialise(s.outside.where(F.col("iso_3166") == "NATION_1").select("year", "concern"))
    return rounded(rounded(K.compare_national(s.est_nat, other, "NATION_1"), "mean"), "outside", digits=4)


_STATES = """o AS (SELECT split_part(mergekey, ':', 2) AS abb, concat(CAST(year - year % 2 AS VARCHAR), '-',
            lpad(CAST((year - year % 2 + 1) % 100 AS VARCHAR), 2, '0')) AS year2, median(concern) AS outside
        FROM outside WHERE iso_3166 = 'NATION_1' AND year BETWEEN 2002 AND 2023 GROUP BY 1, 2),
    j AS (SELECT split_part(mergekey, ':', 2) AS abb, e.year2, mean, mean_scl, o.outside FROM reg_scaled e
          LEFT JOIN o ON split_part(e.mergekey, ':', 2) = o.abb AND e.year2 = o.year2 WHERE iso_3166 = 'NATION_1')"""


def _states(s: Survey) -> DataFrame:
    abb = C.split_label("mergekey", ":", 2)[1]
    other = materialise(s.outside.where(F.col("iso_3166") == "NATION_1").select(abb.alias("abb"), "year", "concern"))
    return K.compare_subnational(rescale01(s.est_reg, "mean", "mean_scl"), other, "NATION_1", sep=":")


@query(
    "k4_subnational_comparison",
    f"""WITH {_STATES}, c AS (SELECT year2, round_even(corr(mean, outside), 2) + 0.0E0 AS corr FROM j WHERE outside IS NOT NULL GROUP BY 1)
        SELECT abb, j.year2, {r("mean")} AS mean, {r("mean_scl")} AS mean_scl, {r("outside", 4)} AS outside, corr
        FROM j LEFT JOIN c ON j.year2 = c.year2""",
)
def _(s: Survey) -> DataFrame:
    return rounded(rounded(_states(s), "mean", "mean_scl"), "outside", digits=4)


@query(
    "k4_subnational_partial_r2",
    f"""WITH {_STATES}, d AS (SELECT abb, mean_scl - avg(mean_scl) OVER g AS y, outside - avg(outside) OVER g AS x FROM j
                              WHERE outside IS NOT NULL WINDOW g AS (PARTITION BY abb))
        SELECT count(*) AS n, count(DISTINCT abb) AS groups, {r("corr(y, x) * corr(y, x)")} AS partial_r2 FROM d""",
)
def _(s: Survey) -> DataFrame:
    return rounded(K.subnational_partial_r2(_states(s)), "partial_r2")


def _scaled_sql(view: str, keys: str) -> str:
    return f"""SELECT {keys}, year2, {r("mean")} AS mean, {r("mean_std")} AS mean_std, {_STD} AS mean_std_bin,
               {r("mean_scl")} AS mean_scl, {_SCL} AS mean_scl_bin FROM {view}"""


_SCALED = ["year2", "mean", "mean_std", "mean_std_bin", "mean_scl", "mean_scl_bin"]


@query("k5_scaled_nations", _scaled_sql("nat_scaled", "iso_3166"))
def _(s: Survey) -> DataFrame:
    out = K.scale_estimates(s.est_nat).select("iso_3166", *_SCALED)
    return rounded(out, "mean", "mean_std", "mean_scl")


@query("k5_scaled_regions", _scaled_sql("reg_scaled", "iso_3166, mergekey"))
def _(s: Survey) -> DataFrame:
    out = K.scale_estimates(s.est_reg).select("iso_3166", "mergekey", *_SCALED)
    return rounded(out, "mean", "mean_std", "mean_scl")


_CORRECTED = f"""WITH {_DRIFT}, {_LINES},
    fixed AS (SELECT e.iso_3166, e.mergekey, e.year2, obs, CASE WHEN later THEN 1 ELSE 0 END AS interpolated,
                     CASE WHEN later THEN mean_interp ELSE mean END AS mean
              FROM drifting e LEFT JOIN interp i ON e.mergekey = i.mergekey AND e.year2 = i.year2),
    corrected AS (SELECT *, (mean - avg(mean) OVER ()) / stddev_samp(mean) OVER () AS mean_std,
                         (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) AS mean_scl FROM fixed)"""


def corrected(s: Survey) -> DataFrame:
    seen = s.drifting.where(F.col("obs") > 0).select("mergekey", "year2", "obs")
    est = s.drifting.select("iso_3166", "mergekey", "year2", "mean")
    return K.clean_estimates(est, seen, s.est_nat, FINAL, end=2008, tol=0.02)


@query("k5_corrected_regions", f"{_CORRECTED} {_scaled_sql('corrected', 'iso_3166, mergekey, obs, interpolated')}")
def _(s: Survey) -> DataFrame:
    out = corrected(s).select("iso_3166", "mergekey", "obs", "interpolated", *_SCALED)
    return rounded(out, "mean", "mean_std", "mean_scl")


@query(
    "k6_corrected_export",
    f"{_CORRECTED} SELECT iso_3166, mergekey, year2, {r('mean_scl')} AS mean_scl FROM corrected WHERE year2 IN ('2002-03', '2008-09')",
)
def _(s: Survey) -> DataFrame:
    out = K.export_periods(corrected(s), "year2", *PAIR).select("iso_3166", "mergekey", "year2", "mean_scl")
    return rounded(out, "mean_scl")


@query(
    "k10_intervals_from_draws",
    f"""WITH v AS (SELECT variable, avg(value) AS mean, quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95 FROM draws GROUP BY 1),
        x AS (SELECT iso_3166, mergekey, mean, q5, q95 FROM v JOIN region_codes c ON variable = concat('region_alpha[', c.regioncode_int, ',1]')),
        y AS (SELECT *, row_number() OVER (ORDER BY mean DESC, mergekey) AS hi, row_number() OVER (ORDER BY mean, mergekey) AS lo FROM x),
        e AS (SELECT *, 'top' AS side FROM y WHERE hi <= 2 UNION ALL SELECT *, 'bottom' FROM y WHERE lo <= 2),
        o AS (SELECT mergekey, row_number() OVER (ORDER BY any_value(mean), mergekey) AS place FROM e GROUP BY mergekey)
        SELECT e.iso_3166, e.mergekey, side, {r("mean")} AS mean, {r("q5")} AS q5, {r("q95")} AS q95, place
        FROM e JOIN o ON e.mergekey = o.mergekey""",
)
def _(s: Survey) -> DataFrame:
    summary = summarise_draws(s.draw_values.select("variable", "value"))
    places = inner_join(s.region_codes, s.stored_cells.select("mergekey", "iso_3166").distinct(), ["mergekey"])
    periods = item_lookup(s.stored_cells, s.stored_nat, "year_int", "year2")
    est = decode_region(summary, places, periods).where(F.col("year2") == "2002-03")
    table = K.interval_table(est.select("iso_3166", "mergekey", "mean", "q5", "q95"), 2, ["mergekey"], "mergekey")
    return rounded(table.select("iso_3166", "mergekey", "side", "mean", "q5", "q95", "place"), "mean", "q5", "q95")


def nations(s: Survey) -> DataFrame:
    return K.scale_estimates(s.est_nat).select("iso_3166", "year2", "mean", "mean_std", "mean_scl")


def regions(s: Survey) -> DataFrame:
    return K.scale_estimates(s.est_reg).select("iso_3166", "mergekey", "year2", "mean", "mean_std", "mean_scl")


@query("k6_two_period_export", f"SELECT iso_3166, year2, {r('mean_scl')} AS mean_scl FROM nat_scaled WHERE year2 IN ('2002-03', '2008-09')")
def _(s: Survey) -> DataFrame:
    return rounded(K.export_periods(nations(s), "year2", *PAIR).select("iso_3166", "year2", "mean_scl"), "mean_scl")


@query(
    "k7_web_export",
    "SELECT k.iso_3166, k.mergekey, "
    + ", ".join(
        f"""{r(f"max(CASE WHEN n.year2 = '{p}' THEN {t}.mean_scl END)")} AS "mean_scl_{level}_{p}\""""
        for p in PAIR
        for level, t in (("regional", "e"), ("national", "n"))
    )
    + """ FROM shapes k LEFT JOIN nat_scaled n ON k.iso_3166 = n.iso_3166 AND n.year2 IN ('2002-03', '2008-09')
          LEFT JOIN reg_scaled e ON k.mergekey = e.mergekey AND e.year2 = n.year2 GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    out = K.web_export(s.shapes.select("iso_3166", "mergekey"), nations(s), regions(s), PAIR)
    return rounded(out, *[c for c in out.columns if c.startswith("mean_scl")])


_MAP = """m AS (SELECT s.iso_3166, s.mergekey, s.continent_name, e.year2, e.mean_std FROM shapes s
            JOIN reg_scaled e ON s.mergekey = e.mergekey AND e.year2 IN ('2002-03', '2008-09') WHERE e.mean_std IS NOT NULL
    UNION ALL SELECT iso_3166, mergekey, continent_name, unnest(['2002-03', '2008-09']), NULL FROM shapes
            WHERE mergekey NOT IN (SELECT mergekey FROM reg_scaled WHERE year2 IN ('2002-03', '2008-09')))"""


def _map(s: Survey) -> DataFrame:
    est = K.export_periods(regions(s), "year2", *PAIR).select("mergekey", "year2", "mean_std")
    return K.map_table(s.shapes, est, "mergekey", PAIR)


@query("k8_map_table", f"WITH {_MAP} SELECT iso_3166, mergekey, continent_name, year2, {r('mean_std')} AS mean_std FROM m")
def _(s: Survey) -> DataFrame:
    return rounded(_map(s), "mean_std")


@query(
    "k9_map_window",
    f"""WITH {_MAP} SELECT iso_3166, mergekey, coalesce(continent_name, 'Missing') AS continent_name, year2, {r("mean_std")} AS mean_std
        FROM m WHERE coalesce(continent_name, 'Missing') IN ('EUROPE', 'ASIA', 'Missing') AND year2 = '2008-09'""",
)
def _(s: Survey) -> DataFrame:
    return rounded(K.region_window(_map(s), ["EUROPE", "ASIA"], FINAL), "mean_std")


def _intervals(s: Survey) -> DataFrame:
    est = s.spread_reg.where(F.col("year2") == FINAL).select("iso_3166", "mergekey", "mean", "q5", "q95")
    named = left_join(est, s.continents, "iso_3166").withColumn("continent_name", F.initcap("continent_name"))
    return named.withColumn("continent_name", K.continent_group())


def _interval_sql(by: str, n: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH x AS (SELECT e.iso_3166, e.mergekey, CASE continent_name WHEN 'ASIA' THEN 'Asia, Oceania' WHEN 'EUROPE' THEN 'Europe, Eurasia'
                          WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'America' ELSE 'Middle East' END AS continent_name, mean, q5, q95
                   FROM spread_reg e JOIN continents k ON e.iso_3166 = k.iso_3166 WHERE year2 = '2008-09'),
        y AS (SELECT *, row_number() OVER ({part}ORDER BY mean DESC, mergekey) AS hi, row_number() OVER ({part}ORDER BY mean, mergekey) AS lo FROM x),
        z AS (SELECT *, 'top' AS side FROM y WHERE hi <= {n} UNION ALL SELECT *, 'bottom' FROM y WHERE lo <= {n}),
        f AS (SELECT concat(mergekey, ', ', iso_3166) AS fullname, * FROM z),
        o AS (SELECT fullname, row_number() OVER (ORDER BY median(mean), fullname) AS place FROM f GROUP BY 1)
        SELECT f.fullname, continent_name, {r("mean")} AS mean, {r("q5")} AS q5, {r("q95")} AS q95, side, place
        FROM f JOIN o ON f.fullname = o.fullname"""


_INTERVAL_COLS = ["fullname", "continent_name", "mean", "q5", "q95", "side", "place"]


@query("k10_world_intervals", _interval_sql("", 20))
def _(s: Survey) -> DataFrame:
    out = K.interval_table(_intervals(s), 20, ["mergekey", "iso_3166"], "mergekey")
    return rounded(out.select(*_INTERVAL_COLS), "mean", "q5", "q95")


@query("k10_continent_intervals", _interval_sql("continent_name", 5))
def _(s: Survey) -> DataFrame:
    out = K.interval_table(_intervals(s), 5, ["mergekey", "iso_3166"], "mergekey", ["continent_name"])
    return rounded(out.select(*_INTERVAL_COLS), "mean", "q5", "q95")


@query(
    "k10_country_intervals",
    f"""WITH x AS (SELECT iso_3166, mean, row_number() OVER (ORDER BY mean, iso_3166) AS k, count(*) OVER () AS n FROM est_nat
                   WHERE year2 = '2008-09')
        SELECT iso_3166, {r("mean")} AS mean, CASE WHEN k <= round_even(n / 2.0E0, 0) THEN 1 ELSE 2 END AS "column" FROM x""",
)
def _(s: Survey) -> DataFrame:
    est = s.est_nat.where(F.col("year2") == FINAL).select("iso_3166", "mean")
    # A mean is rounded before it orders, so that engines agree on near ties.
    return rounded(K.country_intervals(rounded(est, "mean", digits=9)), "mean")


@query(
    "k11_trend_bands",
    f"""SELECT n.iso_3166, year2, {r("mean")} AS mean, {r("q5")} AS q5, {r("q95")} AS q95, continent_name AS name
        FROM spread_nat n LEFT JOIN continents k ON n.iso_3166 = k.iso_3166 ORDER BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    names = s.continents.select("iso_3166", F.col("continent_name").alias("name"))
    return rounded(K.trend_bands(s.spread_nat, names), "mean", "q5", "q95")


@query("k10_fit_intervals")
def _(s: Survey) -> DataFrame:
    """Regions of the last period with the highest and lowest scores of the fit, and their intervals."""
    found = interval(fitted(s).region_scores(), "sd")
    last = _coded_period(s).where(F.col("year2") == FINAL)
    placed = inner_join(inner_join(found, last, ["year_int"]), s.region_codes, ["regioncode_int"])
    named = inner_join(inner_join(placed, s.country_codes, ["iso_3166_int"]), s.continents, ["iso_3166"])
    out = K.interval_table(named.drop("year_int", "regioncode_int", "iso_3166_int", "sd"), 20, ["mergekey", "iso_3166"], "mergekey")
    return rounded(out.select(*_INTERVAL_COLS), "mean", "q5", "q95", digits=4)


@query("k11_fit_bands")
def _(s: Survey) -> DataFrame:
    """Poststratified scores of the fit over the periods, with their intervals."""
    found = interval(fitted(s).national_scores(), "sd")
    named = inner_join(inner_join(found, _coded_period(s), ["year_int"]), s.country_codes, ["iso_3166_int"])
    names = s.continents.select("iso_3166", F.col("continent_name").alias("name"))
    return rounded(K.trend_bands(named, names), "mean", "q5", "q95", digits=4)


def _coded_period(s: Survey) -> DataFrame:
    return item_lookup(s.stored_cells, s.stored_nat, "year_int", "year2")


@query(
    "k12_time_coverage",
    """SELECT year2, iso_3166, continent_name, count(*) AS n FROM (
         SELECT DISTINCT continent_name, iso_3166, mergekey, year2, year_int, question, option FROM cells) t GROUP BY 1, 2, 3""",
)
def _(s: Survey) -> DataFrame:
    return K.coverage_tally(s.cells)


@query(
    "k13_item_table",
    f"""SELECT question, split_part(question, '_', 1) AS category, substr(question, length(split_part(question, '_', 1)) + 2) AS short,
               {r("discrimination")} AS mean, row_number() OVER (ORDER BY discrimination, question) AS place FROM disc""",
)
def _(s: Survey) -> DataFrame:
    out = K.item_table(_disc(s).withColumnRenamed("discrimination", "mean"))
    return rounded(out.select("question", "category", "short", "mean", "place"), "mean")


@query(
    "k13_item_quartiles",
    "SELECT "
    + ", ".join(f"{r(f'quantile_cont(discrimination, {p})')} AS q{int(100 * p)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0))
    + " FROM disc",
)
def _(s: Survey) -> DataFrame:
    out = K.item_quartiles(_disc(s).withColumnRenamed("discrimination", "mean"))
    return rounded(out, *out.columns)


_SAMPLED = """w AS (SELECT mergekey, CAST(sum(size) AS BIGINT) AS n FROM cells GROUP BY 1),
    g AS (SELECT e.iso_3166, e.mergekey, e.mean_scl, n FROM reg_scaled e JOIN w ON e.mergekey = w.mergekey
          WHERE e.year2 = '2008-09' AND n > {min_n} AND e.mergekey NOT IN ('NATION_3:BUILDING')),
    lq AS (SELECT g.*, g.mean_scl / nullif(k.mean_scl, 0) * 100 AS reg_ratio FROM g
           JOIN nat_scaled k ON g.iso_3166 = k.iso_3166 AND k.year2 = '2008-09')"""
MIN_REGION, MIN_NATION = 999, 6000


def _sampled(s: Survey) -> DataFrame:
    reg = regions(s).where(F.col("year2") == FINAL).select("iso_3166", "mergekey", "mean_scl")
    return K.sampled_regions(reg, s.stored_cells, MIN_REGION, ("NATION_3:BUILDING",))


def _quotients(s: Survey) -> DataFrame:
    return K.location_quotient(_sampled(s), nations(s).where(F.col("year2") == FINAL))


@query(
    "k14_location_quotient",
    f"WITH {_SAMPLED.format(min_n=MIN_REGION)} SELECT iso_3166, mergekey, n, {r('reg_ratio', 4)} AS reg_ratio FROM lq",
)
def _(s: Survey) -> DataFrame:
    return rounded(_quotients(s).select("iso_3166", "mergekey", "n", "reg_ratio"), "reg_ratio", digits=4)


@query(
    "k14_quotient_extremes",
    f"""WITH {_SAMPLED.format(min_n=MIN_REGION)},
        y AS (SELECT iso_3166, mergekey, reg_ratio, row_number() OVER (PARTITION BY iso_3166 ORDER BY reg_ratio DESC, mergekey) AS hi,
                     row_number() OVER (PARTITION BY iso_3166 ORDER BY reg_ratio, mergekey) AS lo FROM lq
              WHERE iso_3166 IN ('NATION_1', 'NATION_2', 'NATION_4') AND reg_ratio IS NOT NULL)
        SELECT iso_3166, mergekey, {r("reg_ratio", 4)} AS reg_ratio, 'top' AS side FROM y WHERE hi <= 2
        UNION ALL SELECT iso_3166, mergekey, {r("reg_ratio", 4)}, 'bottom' FROM y WHERE lo <= 2""",
)
def _(s: Survey) -> DataFrame:
    out = K.quotient_extremes(_quotients(s), ("NATION_1", "NATION_2", "NATION_4"), 2)
    return rounded(out, "reg_ratio", digits=4)


@query(
    "k15_variation_tables",
    f"""WITH {_SAMPLED.format(min_n=MIN_REGION)},
        v AS (SELECT iso_3166, avg(mean_scl) AS m, stddev_samp(mean_scl) AS sd, stddev_samp(mean_scl) / nullif(avg(mean_scl), 0) AS cv
              FROM g GROUP BY 1),
        c AS (SELECT iso_3166, CAST(sum(size) AS BIGINT) AS n FROM cells GROUP BY 1),
        j AS (SELECT v.*, k.mean_scl AS nat, c.n FROM v JOIN nat_scaled k ON v.iso_3166 = k.iso_3166 AND k.year2 = '2008-09'
              LEFT JOIN c ON v.iso_3166 = c.iso_3166),
        u AS (SELECT *, 'listed' AS t FROM j WHERE iso_3166 IN ('NATION_1', 'NATION_2', 'NATION_4')
              UNION ALL SELECT *, 'sample' FROM j WHERE n > {MIN_NATION} AND cv IS NOT NULL)
        SELECT iso_3166, {r("m")} AS nat_regionmean, {r("sd")} AS nat_regionsd, {r("cv")} AS nat_cv, {r("nat")} AS nat_mean_scl,
               n, t AS "table" FROM u""",
)
def _(s: Survey) -> DataFrame:
    final = nations(s).where(F.col("year2") == FINAL)
    out = K.cv_tables(_sampled(s), final, s.stored_cells, ("NATION_1", "NATION_2", "NATION_4"), MIN_NATION)
    return rounded(out, "nat_regionmean", "nat_regionsd", "nat_cv", "nat_mean_scl")


@query(
    "k16_respondent_counts",
    """SELECT CAST(l_orderkey % 3 AS VARCHAR) AS constructed, count(*) AS respondents,
              count(*) FILTER (WHERE coalesce(q_a_f, q_a_o, q_n_f, q_n_o, q_r_f, q_r_o) IS NOT NULL) AS answered FROM resp_wide GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    coded = s.wide.withColumn("constructed", F.col("l_orderkey") % 3)
    return K.respondent_counts(coded, QUESTION_COLS, "constructed")


@query(
    "k16_full_sample",
    """SELECT count(*) FILTER (WHERE coalesce(q_a_f, q_a_o, q_n_f, q_n_o, q_r_f, q_r_o) IS NOT NULL AND o_orderstatus <> 'P') AS shared,
              count(*) FILTER (WHERE o_orderstatus = 'P') AS withheld,
              count(*) FILTER (WHERE o_orderstatus = 'P' OR coalesce(q_a_f, q_a_o, q_n_f, q_n_o, q_r_f, q_r_o) IS NOT NULL) AS total
       FROM resp_wide JOIN orders ON l_orderkey = o_orderkey""",
)
def _(s: Survey) -> DataFrame:
    orders = s.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = materialise(inner_join(s.wide, orders, ["l_orderkey"]).select("o_orderstatus", *QUESTION_COLS))
    own = F.col("o_orderstatus") == "P"
    return K.full_sample(rows.where(~own), QUESTION_COLS, rows.where(own))


@query(
    "k16_place_counts",
    """SELECT count(DISTINCT iso_3166) AS iso_3166,
              count(DISTINCT CASE WHEN NOT regexp_matches(mergekey, '.nat') THEN mergekey END) AS mergekey FROM cells""",
)
def _(s: Survey) -> DataFrame:
    return K.place_counts(s.cells)
