"""Queries of the published tables in ``published``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.operators.aggregate import country_obs, question_obs
from pollspark.operators.relate import inner_join
from pollspark.plans import published as U
from pollspark.plans import reports as K
from pollspark.plans.fixtures import FINAL, QUESTIONS, Survey
from pollspark.plans.queries_reports import _CORRECTED, PAIR, corrected, nations
from pollspark.plans.queries_statistics import per_head
from pollspark.plans.registry import query, r, rounded

_SERIES = """m AS (SELECT question, iso_3166, year2, sum(yes * option) * 1.0E0 / sum(yes) AS yes FROM cells GROUP BY 1, 2, 3),
        n AS (SELECT question, count(DISTINCT year2) AS n FROM m GROUP BY 1 HAVING count(DISTINCT year2) >= 3),
        t AS (SELECT m.question, m.iso_3166, m.year2, n.n,
                     (yes - avg(yes) OVER (PARTITION BY m.question)) / stddev_samp(yes) OVER (PARTITION BY m.question) AS yes_scl
              FROM m JOIN n ON m.question = n.question)"""


def _series(s: Survey) -> DataFrame:
    means = s.stored_cells.groupBy("question", "iso_3166", "year2").agg(
        (F.sum(F.col("yes") * F.col("option")) / F.sum("yes")).alias("yes"), F.sum("yes").alias("size")
    )
    return U.long_series_means(means)


@query(
    "s4_series_prediction",
    f"""WITH {_SERIES},
        p AS (SELECT t.question, t.n, yes_scl - avg(yes_scl) OVER g AS y, e.mean - avg(e.mean) OVER g AS x
              FROM t JOIN est_nat e ON t.iso_3166 = e.iso_3166 AND t.year2 = e.year2 WINDOW g AS (PARTITION BY t.question, t.iso_3166))
        SELECT p.question, any_value(n) AS periods_asked, {r("corr(y, x) * corr(y, x)")} AS partial_r2, {r("any_value(gamma_raw)")} AS discrimination
        FROM p JOIN item_gamma g ON p.question = g.question GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    disc = s.item_gamma.select("question", F.col("gamma_raw").alias("discrimination"))
    return rounded(U.series_prediction(_series(s), s.est_nat, disc), "partial_r2", "discrimination")


@query(
    "s5_series_pairs",
    f"""WITH {_SERIES},
        p AS (SELECT b.question AS x, a.question AS y, a.iso_3166, a.yes_scl AS ya, b.yes_scl AS xb FROM t a JOIN t b
              ON a.iso_3166 = b.iso_3166 AND a.year2 = b.year2 AND a.question < b.question),
        d AS (SELECT x, y, iso_3166, ya - avg(ya) OVER g AS ya, xb - avg(xb) OVER g AS xb, count(*) OVER g AS years FROM p
              WINDOW g AS (PARTITION BY x, y, iso_3166))
        SELECT x, y, {r("corr(ya, xb) * corr(ya, xb)")} AS partial_r2, count(*) - count(DISTINCT iso_3166) - 1 AS df, max(years) AS n_years
        FROM d GROUP BY 1, 2 HAVING count(*) - count(DISTINCT iso_3166) - 1 > 10""",
)
def _(s: Survey) -> DataFrame:
    return rounded(U.series_pairs(_series(s), QUESTIONS), "partial_r2")


@query(
    "s6_exposure_regression",
    f"""WITH z AS (SELECT n.iso_3166, year2, mean_std, (exposure - avg(exposure) OVER ()) / stddev_samp(exposure) OVER () AS x
                   FROM nat_scaled n LEFT JOIN exposure e ON n.iso_3166 = e.iso_3166 WHERE year2 IN ('2002-03', '2008-09')),
        p AS (SELECT iso_3166, mean_std AS y, x FROM z WHERE year2 = '2008-09' AND x IS NOT NULL),
        l AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b FROM p),
        e AS (SELECT l.*, x - mx AS dx, y - my - b * (x - mx) AS e FROM p, l),
        w AS (SELECT *, e * e / (1 - 1.0E0 / n - dx * dx / sxx) AS v FROM e)
        SELECT any_value(n) AS n, {r("any_value(my - b * mx)")} AS intercept, {r("any_value(b)")} AS slope,
               {r("sqrt(sum((1.0E0 / n - mx * dx / sxx) * (1.0E0 / n - mx * dx / sxx) * v))")} AS intercept_se,
               {r("sqrt(sum(dx / sxx * dx / sxx * v))")} AS slope_se FROM w""",
)
def _(s: Survey) -> DataFrame:
    found = U.exposure_regression(s.est_nat, s.exposure, PAIR, FINAL)
    return rounded(found.select("n", "intercept", "slope", "intercept_se", "slope_se"), "intercept", "slope", "intercept_se", "slope_se")


@query(
    "s7_emissions_regression",
    f"""WITH h AS (SELECT t.mergekey, CASE WHEN tons > 0 THEN ln(tons / region_pop) END AS ln_percap
                   FROM (SELECT mergekey, sum(emissions / 1000.0E0) * 1000 AS tons FROM emissions GROUP BY 1) t JOIN weights w ON t.mergekey = w.mergekey),
        z AS (SELECT e.iso_3166, (mean - avg(mean) OVER ()) / stddev_samp(mean) OVER () AS y,
                     (ln_percap - avg(ln_percap) OVER ()) / stddev_samp(ln_percap) OVER () AS x
              FROM est_reg e JOIN continents k ON e.iso_3166 = k.iso_3166 LEFT JOIN h ON e.mergekey = h.mergekey
              WHERE year2 = '2008-09' AND continent_name = 'EUROPE'),
        p AS (SELECT * FROM z WHERE x IS NOT NULL),
        l AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b FROM p),
        e AS (SELECT iso_3166, l.*, x - mx AS dx, y - my - b * (x - mx) AS e FROM p, l),
        u AS (SELECT iso_3166, any_value(n) AS n, any_value(my - b * mx) AS a, any_value(b) AS b, sum(dx / sxx * e) AS u,
                     sum((1.0E0 / n - mx * dx / sxx) * e) AS v FROM e GROUP BY 1)
        SELECT any_value(n) AS n, count(*) AS clusters, {r("any_value(a)")} AS intercept, {r("any_value(b)")} AS slope,
               {r("sqrt(sum(u * u) * count(*) / (count(*) - 1.0E0) * (any_value(n) - 1.0E0) / (any_value(n) - 2))")} AS slope_se,
               {r("sqrt(sum(v * v) * count(*) / (count(*) - 1.0E0) * (any_value(n) - 1.0E0) / (any_value(n) - 2))")} AS intercept_se FROM u""",
)
def _(s: Survey) -> DataFrame:
    regions = inner_join(s.est_reg, s.continents, ["iso_3166"])
    found = U.emissions_regression(regions, per_head(s), "EUROPE", FINAL)
    kept = found.select("n", "clusters", "intercept", "slope", "slope_se", "intercept_se")
    return rounded(kept, "intercept", "slope", "slope_se", "intercept_se")


@query(
    "h1_extreme_changes",
    f"""WITH d AS (SELECT iso_3166, max(CASE WHEN year2 = '2002-03' THEN mean_scl END) AS a, max(CASE WHEN year2 = '2008-09' THEN mean_scl END) AS z
                   FROM nat_scaled GROUP BY 1),
        y AS (SELECT iso_3166, round(z - a, 9) AS delta, row_number() OVER (ORDER BY round(z - a, 9) DESC, iso_3166) AS hi,
                     row_number() OVER (ORDER BY round(z - a, 9), iso_3166) AS lo FROM d WHERE z - a IS NOT NULL),
        e AS (SELECT *, 'top' AS side FROM y WHERE hi <= 10 UNION ALL SELECT *, 'bottom' FROM y WHERE lo <= 10),
        o AS (SELECT iso_3166, row_number() OVER (ORDER BY any_value(delta), iso_3166) AS place FROM e GROUP BY 1)
        SELECT e.iso_3166, {r("delta")} AS delta, CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'stable' END AS change,
               side, place FROM e JOIN o ON e.iso_3166 = o.iso_3166""",
)
def _(s: Survey) -> DataFrame:
    out = U.extreme_changes(rounded(nations(s), "mean_scl", digits=12), *PAIR)
    return rounded(out.select("iso_3166", "delta", "change", "side", "place"), "delta")


@query(
    "f7_countries_with_obs",
    f"""WITH o AS (SELECT iso_3166, year2, 1 AS obs FROM cells WHERE size > 0 UNION SELECT iso_3166, year2, 1 FROM cells_nat WHERE size > 0)
        SELECT e.iso_3166, e.year2, {r("mean")} AS mean, coalesce(obs, 0) AS obs FROM est_nat e
        LEFT JOIN o ON e.iso_3166 = o.iso_3166 AND e.year2 = o.year2""",
)
def _(s: Survey) -> DataFrame:
    obs = country_obs(s.stored_cells, s.stored_nat, "iso_3166", "year2")
    return rounded(U.with_obs(s.est_nat.select("iso_3166", "year2", "mean"), obs, ["iso_3166", "year2"]), "mean")


@query(
    "f8_questions_with_obs",
    f"""WITH o AS (SELECT question, count(*) AS obs FROM (
                     SELECT DISTINCT question, size, year2, mergekey, iso_3166 FROM cells WHERE size > 0
                     UNION ALL SELECT DISTINCT question, size, year2, NULL, iso_3166 FROM cells_nat WHERE size > 0) t GROUP BY 1)
        SELECT g.question, {r("gamma_raw")} AS discrimination, coalesce(obs, 0) AS obs FROM item_gamma g LEFT JOIN o ON g.question = o.question""",
)
def _(s: Survey) -> DataFrame:
    obs = question_obs(s.stored_cells, s.stored_nat, "mergekey", "iso_3166", "year2")
    disc = s.item_gamma.select("question", F.col("gamma_raw").alias("discrimination"))
    return rounded(U.with_obs(disc, obs, ["question"]), "discrimination")


@query(
    "k7_corrected_web_export",
    _CORRECTED + " SELECT k.iso_3166, k.mergekey, "
    + ", ".join(
        f"""{r(f"max(CASE WHEN n.year2 = '{p}' THEN {t}.mean_scl END)")} AS "mean_scl_{level}_{p}\""""
        for p in PAIR
        for level, t in (("regional", "e"), ("national", "n"))
    )
    + """ FROM shapes k LEFT JOIN nat_scaled n ON k.iso_3166 = n.iso_3166 AND n.year2 IN ('2002-03', '2008-09')
          LEFT JOIN corrected e ON k.mergekey = e.mergekey AND e.year2 = n.year2 GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    out = K.web_export(s.shapes.select("iso_3166", "mergekey"), nations(s), corrected(s), PAIR)
    return rounded(out, *[c for c in out.columns if c.startswith("mean_scl")])


@query(
    "k8_corrected_map_table",
    f"""{_CORRECTED}, m AS (SELECT s.iso_3166, s.mergekey, s.continent_name, e.year2, e.mean_std FROM shapes s
            JOIN corrected e ON s.mergekey = e.mergekey AND e.year2 IN ('2002-03', '2008-09') WHERE e.mean_std IS NOT NULL
        UNION ALL SELECT iso_3166, mergekey, continent_name, unnest(['2002-03', '2008-09']), NULL FROM shapes
            WHERE mergekey NOT IN (SELECT mergekey FROM corrected WHERE year2 IN ('2002-03', '2008-09') AND mean_std IS NOT NULL))
        SELECT iso_3166, mergekey, continent_name, year2, {r("mean_std")} AS mean_std FROM m""",
)
def _(s: Survey) -> DataFrame:
    est = K.export_periods(corrected(s), "year2", *PAIR).select("mergekey", "year2", "mean_std")
    return rounded(K.map_table(s.shapes, est, "mergekey", PAIR), "mean_std")


@query(
    "k14_corrected_quotient",
    f"""{_CORRECTED} SELECT e.iso_3166, e.mergekey, {r("e.mean_scl / nullif(n.mean_scl, 0) * 100", 4)} AS reg_ratio
        FROM corrected e JOIN nat_scaled n ON e.iso_3166 = n.iso_3166 AND n.year2 = '2008-09' WHERE e.year2 = '2008-09'""",
)
def _(s: Survey) -> DataFrame:
    own = corrected(s).where(F.col("year2") == FINAL).select("iso_3166", "mergekey", "mean_scl")
    found = K.location_quotient(own, nations(s).where(F.col("year2") == FINAL))
    return rounded(found.select("iso_3166", "mergekey", "reg_ratio"), "reg_ratio", digits=4)
