"""Regression, validation and dimensionality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.operators import dimension as N
from pollspark.operators import regress as J
from pollspark.operators.ranking import row_numbers
from pollspark.operators.relate import inner_join
from pollspark.operators.shape import pivot_longer, pivot_wider
from pollspark.plans.fixtures import EMBEDDED, FINAL, QUESTION_COLS, QUESTIONS, Survey
from pollspark.plans.queries_relations import region_means
from pollspark.plans.registry import query, r, rounded
from pollspark.session import materialise

EMBEDDING_SIZE = 64

_PERCAP = """t AS (SELECT iso_3166, mergekey, sum(emissions / 1000.0E0) * 1000 AS tons FROM emissions GROUP BY 1, 2),
    q AS (SELECT t.iso_3166, t.mergekey, tons / region_pop AS percap, ln(tons / region_pop) AS percap_ln
          FROM t JOIN weights w ON t.mergekey = w.mergekey),
    pc AS (SELECT *, (percap_ln - avg(percap_ln) OVER ()) / stddev_samp(percap_ln) OVER () AS percap_ln_std FROM q)"""
_EXPOSED = """p AS (SELECT n.iso_3166, n.mean AS y, x.exposure AS x FROM est_nat n JOIN exposure x ON n.iso_3166 = x.iso_3166
          WHERE x.exposure IS NOT NULL)"""
_BURNT = """p AS (SELECT e.iso_3166, e.mean AS y, pc.percap_ln_std AS x FROM est_reg e JOIN pc ON e.mergekey = pc.mergekey
          WHERE pc.percap_ln_std IS NOT NULL)"""


def exposed(s: Survey) -> DataFrame:
    return inner_join(s.est_nat, s.exposure, ["iso_3166"])


def per_head(s: Survey) -> DataFrame:
    """Emissions per head: part returns stand for the finer outside regions."""
    code = F.concat_ws("/", "mergekey", "l_returnflag")
    lines = s.energy.select(code.alias("code"), F.col("iso_3166").alias("country"), "mergekey", "l_extendedprice")
    # Summed once; both inputs are read from the sums.
    sums = materialise(lines.groupBy("code", "country", "mergekey").agg((F.sum("l_extendedprice") / 1000).alias("kilotons")))
    kilotons = sums.select("code", "country", "kilotons")
    crosswalk = sums.select("code", "mergekey").distinct()
    return J.emissions_per_capita(kilotons, crosswalk, s.population.select("mergekey", "region_pop"))


def burnt(s: Survey) -> DataFrame:
    return inner_join(s.est_reg, per_head(s).drop("country"), ["mergekey"])


@query(
    "j1_robust_regression",
    f"""WITH {_EXPOSED},
        l AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
                     regr_slope(y, x) AS b FROM p),
        e AS (SELECT l.*, x - mx AS dx, y - my - b * (x - mx) AS e FROM p, l),
        w AS (SELECT *, e * e / (1 - 1.0E0 / n - dx * dx / sxx) AS v FROM e),
        o AS (SELECT any_value(n) AS n, any_value(my - b * mx) AS a, any_value(b) AS b, sum(e * e) AS rss, any_value(syy) AS syy,
                     sqrt(sum((1.0E0 / n - mx * dx / sxx) * (1.0E0 / n - mx * dx / sxx) * v)) AS ase,
                     sqrt(sum(dx / sxx * dx / sxx * v)) AS bse FROM w)
        SELECT n, {r("a")} AS intercept, {r("ase")} AS intercept_se, {r("b", 9)} AS slope, {r("bse", 9)} AS slope_se,
               {r("1 - rss / syy")} AS r2, {r("1 - rss / syy * (n - 1) / (n - 2)")} AS adj_r2, {r("sqrt(rss / (n - 2))")} AS rmse
        FROM o""",
)
def _(s: Survey) -> DataFrame:
    fit = J.ols_robust(exposed(s), "mean", "exposure")
    return rounded(rounded(fit, "intercept", "intercept_se", "r2", "adj_r2", "rmse"), "slope", "slope_se", digits=9)


@query(
    "j2_country_effects_regression",
    f"""WITH {_PERCAP}, {_BURNT},
        c AS (SELECT iso_3166, y, x, y - avg(y) OVER g AS dy, x - avg(x) OVER g AS dx, count(*) OVER g AS ng FROM p
              WINDOW g AS (PARTITION BY iso_3166)),
        l AS (SELECT count(*) AS n, count(DISTINCT iso_3166) AS groups, sum(dx * dx) AS sxx, sum(dx * dy) / sum(dx * dx) AS b FROM c),
        m AS (SELECT sum(CASE WHEN 1.0E0 / ng + dx * dx / sxx < 1 - 1e-12
                     THEN dx * dx * (dy - b * dx) * (dy - b * dx) / (1 - 1.0E0 / ng - dx * dx / sxx) ELSE 0 END) AS meat FROM c, l)
        SELECT n, groups, {r("b")} AS slope, {r("sqrt(meat) / sxx")} AS slope_se FROM l, m""",
)
def _(s: Survey) -> DataFrame:
    return rounded(J.ols_within(burnt(s), "mean", "percap_ln_std", "iso_3166"), "slope", "slope_se")


_CLUSTER = f"""WITH {_PERCAP}, {_BURNT},
        l AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b FROM p),
        e AS (SELECT iso_3166, l.*, x - mx AS dx, y - my - b * (x - mx) AS e FROM p, l),
        u AS (SELECT iso_3166, any_value(n) AS n, any_value(my - b * mx) AS a, any_value(b) AS b, sum(dx / sxx * e) AS u,
                     sum((1.0E0 / n - mx * dx / sxx) * e) AS v FROM e GROUP BY 1),
        o AS (SELECT any_value(n) AS n, count(*) AS clusters, any_value(a) AS a, any_value(b) AS b,
                     sqrt(sum(u * u) * count(*) / (count(*) - 1.0E0) * (any_value(n) - 1.0E0) / (any_value(n) - 2)) AS bse,
                     sqrt(sum(v * v) * count(*) / (count(*) - 1.0E0) * (any_value(n) - 1.0E0) / (any_value(n) - 2)) AS ase FROM u)"""


@query(
    "j3_clustered_regression",
    f"""{_CLUSTER} SELECT n, clusters, {r("a")} AS intercept, {r("ase")} AS intercept_se, {r("b")} AS slope, {r("bse")} AS slope_se,
               {r("a / ase", 4)} AS intercept_t, {r("b / bse", 4)} AS slope_t FROM o""",
)
def _(s: Survey) -> DataFrame:
    fit = J.ols_cluster(burnt(s), "mean", "percap_ln_std", "iso_3166")
    fit = rounded(fit, "intercept", "intercept_se", "slope", "slope_se")
    return rounded(fit, "intercept_t", "slope_t", digits=4)


# Two-sided p value: Student's density summed by Simpson's rule between 0 and the t value.
@query(
    "j3_coefficient_table",
    f"""{_CLUSTER}, terms AS (SELECT 'intercept' AS term, a AS est, ase AS se, a / ase AS t, clusters - 1.0E0 AS df FROM o
               UNION ALL SELECT 'slope', b, bse, b / bse, clusters - 1.0E0 FROM o),
        points AS (SELECT *, unnest(range(0, 4001)) AS i FROM terms),
        areas AS (SELECT term, est, se, t, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * abs(t) / 4000 / 3
                     * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
                     * pow(1 + pow(abs(t) * i / 4000.0E0, 2) / df, -(df + 1) / 2) AS area FROM points)
        SELECT term, {r("any_value(est)")} AS estimate, {r("any_value(se)")} AS std_error, {r("any_value(t)", 4)} AS t_value,
               {r("1 - 2 * sum(area)")} AS p_value FROM areas GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    found = J.coefficient_table(J.ols_cluster(burnt(s), "mean", "percap_ln_std", "iso_3166"))
    return rounded(rounded(found, "estimate", "std_error", "p_value"), "t_value", digits=4)


@query(
    "j4_partial_r2",
    f"""WITH {_PERCAP}, {_BURNT},
        d AS (SELECT iso_3166, y - avg(y) OVER g AS y, x - avg(x) OVER g AS x FROM p WINDOW g AS (PARTITION BY iso_3166))
        SELECT count(*) AS n, count(DISTINCT iso_3166) AS groups, {r("corr(y, x) * corr(y, x)")} AS partial_r2 FROM d""",
)
def _(s: Survey) -> DataFrame:
    return rounded(J.partial_r2(burnt(s), "mean", "percap_ln_std", "iso_3166"), "partial_r2")


@query(
    "j4_partial_r2_by_question",
    f"""WITH p AS (SELECT m.question, m.mergekey, avg_resp AS y, e.mean AS x FROM region_means m
                   JOIN est_reg e ON m.mergekey = e.mergekey AND m.year2 = e.year2),
        d AS (SELECT question, mergekey, y - avg(y) OVER g AS y, x - avg(x) OVER g AS x FROM p
              WINDOW g AS (PARTITION BY question, mergekey))
        SELECT question, count(*) AS n, count(DISTINCT mergekey) AS groups, {r("corr(y, x) * corr(y, x)")} AS partial_r2
        FROM d GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    joined = inner_join(region_means(s), s.est_reg.select("mergekey", "year2", "mean"), ["mergekey", "year2"])
    return rounded(J.partial_r2(joined, "avg_resp", "mean", "mergekey", ["question"]), "partial_r2")


@query(
    "j5_pairwise_partial_r2",
    f"""WITH p AS (SELECT b.question AS x, a.question AS y, a.mergekey, a.avg_resp AS ya, b.avg_resp AS xb FROM region_means a
                   JOIN region_means b ON a.mergekey = b.mergekey AND a.year2 = b.year2 AND a.question < b.question),
        d AS (SELECT x, y, mergekey, ya - avg(ya) OVER g AS ya, xb - avg(xb) OVER g AS xb, count(*) OVER g AS years FROM p
              WINDOW g AS (PARTITION BY x, y, mergekey))
        SELECT x, y, {r("corr(ya, xb) * corr(ya, xb)")} AS partial_r2, count(*) - count(DISTINCT mergekey) - 1 AS df,
               max(years) AS n_years FROM d GROUP BY 1, 2
        HAVING count(*) - count(DISTINCT mergekey) - 1 > 10""",
)
def _(s: Survey) -> DataFrame:
    wide = pivot_wider(region_means(s), ["mergekey", "year2"], "question", "avg_resp", QUESTIONS)
    return rounded(J.pairwise_partial_r2(wide, QUESTIONS, "mergekey"), "partial_r2")


@query(
    "j6_fitted_lines",
    f"""WITH {_PERCAP}, p AS (SELECT e.year2, e.mean AS y, pc.percap_ln_std AS x FROM est_reg e JOIN pc ON e.mergekey = pc.mergekey)
        SELECT year2, regr_count(y, x) AS n, {r("regr_slope(y, x)")} AS slope, {r("regr_intercept(y, x)")} AS intercept
        FROM p GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return rounded(J.fit_line(burnt(s), "mean", "percap_ln_std", ["year2"]), "slope", "intercept")


@query(
    "j7_near_average_items",
    f"""WITH m AS (SELECT round_even(exp(avg(ln(gamma_raw))), 1) AS g FROM item_gamma)
        SELECT question, {r("gamma_raw")} AS gamma_raw FROM item_gamma, m
        WHERE gamma_raw BETWEEN round(g - 0.2E0, 6) AND round(g + 0.2E0, 6)""",
)
def _(s: Survey) -> DataFrame:
    return rounded(J.near_average_items(s.item_gamma.drop("kmin1"), "gamma_raw", 0.2), "gamma_raw")


@query(
    "j8_quadrant_labels",
    f"""WITH p AS (SELECT n.iso_3166, n.mean AS y, x.exposure AS x FROM est_nat n JOIN exposure x ON n.iso_3166 = x.iso_3166
                   WHERE n.year2 = '2008-09'),
        k AS (SELECT quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.75) AS x3, quantile_cont(y, 0.25) AS y1,
                     quantile_cont(y, 0.75) AS y3 FROM p)
        SELECT iso_3166, {r("x", 4)} AS exposure, {r("y")} AS mean,
               CASE WHEN iso_3166 IN ('NATION_1', 'NATION_3') THEN 'emitter' ELSE 'outlier' END AS type
        FROM p, k WHERE ((x < x1 OR x > x3) AND (y < y1 OR y > y3)) OR iso_3166 IN ('NATION_1', 'NATION_3')""",
)
def _(s: Survey) -> DataFrame:
    rows = exposed(s).where(F.col("year2") == FINAL).select("iso_3166", "exposure", "mean")
    out = J.quadrants(rows, "exposure", "mean", "iso_3166", ("NATION_1", "NATION_3"))
    return rounded(rounded(out, "mean"), "exposure", digits=4)


@query(
    "j9_emissions_per_head",
    f"""WITH {_PERCAP} SELECT iso_3166 AS country, mergekey, {r("percap_ln")} AS percap_ln, {r("percap_ln_std")} AS percap_ln_std
        FROM pc""",
)
def _(s: Survey) -> DataFrame:
    # The logarithm is compared: money over a head count often ends in an exact half.
    return rounded(per_head(s).select("country", "mergekey", "percap_ln", "percap_ln_std"), "percap_ln", "percap_ln_std")


@query(
    "j10_country_item_means",
    f"""WITH m AS (SELECT iso_3166, year2, question, avg(answer) AS v FROM resp_long GROUP BY 1, 2, 3 HAVING count(answer) > 0),
        z AS (SELECT iso_3166, question, CASE WHEN stddev_samp(v) OVER g > 0 THEN (v - avg(v) OVER g) / stddev_samp(v) OVER g END AS z
              FROM m WINDOW g AS (PARTITION BY question, year2))
        SELECT iso_3166, question, {r("avg(z)")} AS val FROM z GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    return rounded(N.country_item_means(s.wide, QUESTION_COLS, "iso_3166", "year2"), "val")


@query(
    "j11_screened_items",
    "WITH "
    + ", ".join(
        f"z_{c} AS (SELECT '{c}' AS item, ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z, sum({c}) OVER () AS total FROM embedded)"
        for c in EMBEDDED
    )
    + " "
    + " UNION ALL ".join(f"SELECT item, {r('z')} AS z FROM z_{c} WHERE total > 0" for c in EMBEDDED),
)
def _(s: Survey) -> DataFrame:
    scaled, kept = N.screen_items(s.embedded, EMBEDDED)
    return rounded(pivot_longer(scaled, [], kept, "item", "z"), "z")


def _screened(s: Survey) -> tuple[DataFrame, list[str]]:
    names = [f"v{i}" for i in range(1, EMBEDDING_SIZE + 1)]
    wide = s.table("embeddings").select(*[F.element_at("embedding", i).cast("double").alias(c) for i, c in enumerate(names, 1)])
    return N.screen_items(wide, names)


# The eigenvalues add up to the number of items, their squares to the sum of squared correlations.
@query(
    "j12_eigenvalue_sums",
    f"""WITH e AS (SELECT vec_id, unnest(range(1, {EMBEDDING_SIZE + 1})) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
        k AS (SELECT i FROM e GROUP BY 1 HAVING sum(v) > 0 AND min(v) < max(v)),
        z AS (SELECT e.vec_id, e.i, (v - avg(v) OVER g) / stddev_samp(v) OVER g AS z FROM e JOIN k ON e.i = k.i WINDOW g AS (PARTITION BY e.i)),
        c AS (SELECT a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS c FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY 1, 2)
        SELECT CAST(count(DISTINCT i) AS BIGINT) AS items, {r("count(DISTINCT i)", 4)} AS total, {r("sum(c * c)", 4)} AS squares FROM c""",
)
def _(s: Survey) -> DataFrame:
    scaled, kept = _screened(s)
    eigen = N.eigen_table(s.spark, N.eigenvalues(scaled, kept))
    sums = eigen.agg(
        F.count(F.lit(1)).alias("items"), F.sum("eigenvalue").alias("total"),
        F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares"),
    )
    return rounded(sums, "total", "squares", digits=4)


@query("j12_eigenvalues")
def _(s: Survey) -> DataFrame:
    scaled, kept = _screened(s)
    return N.eigen_table(s.spark, N.eigenvalues(scaled, kept))


@query("j13_parallel_analysis")
def _(s: Survey) -> DataFrame:
    scaled, kept = _screened(s)
    return N.parallel_analysis(s.spark, scaled.count(), len(kept))


@query("j14_permuted_null")
def _(s: Survey) -> DataFrame:
    scaled, kept = _screened(s)
    return N.permuted_analysis(scaled, kept)


@query("j14_number_of_factors")
def _(s: Survey) -> DataFrame:
    """Factor counts of the embeddings' entries, against the same columns shuffled."""
    scaled, kept = _screened(s)
    rows = materialise(scaled)
    return N.n_factors(N.eigen_table(s.spark, N.eigenvalues(rows, kept)), N.permuted_analysis(rows, kept))


@query(
    "j14_factor_rules",
    """WITH n AS (SELECT iso_3166, sum(yes) AS n FROM cells GROUP BY 1),
        v AS (SELECT row_number() OVER (ORDER BY n DESC, iso_3166) AS rank, round(n * n * n / avg(n * n * n) OVER (), 6) AS v FROM n),
        e AS (SELECT rank, v, round(1.2E0 - 0.04E0 * rank, 6) AS par, count(*) OVER () AS p, avg(v) OVER () AS mu,
                     lead(v) OVER o AS after, lag(v) OVER o AS before, lag(rank) OVER o AS r0 FROM v WINDOW o AS (ORDER BY rank)),
        f AS (SELECT *, (SELECT v FROM e x ORDER BY rank DESC LIMIT 1) AS final, before >= round(1.2E0 - 0.04E0 * r0, 6) AS ok,
                     after - 2 * v + before AS bend FROM e),
        g AS (SELECT *, after - CASE WHEN p - rank - 1 = 0 OR after IS NULL THEN 0 ELSE (final - after) / (p - rank - 1) END AS line FROM f)
        SELECT CAST(count(*) FILTER (WHERE v >= mu) AS BIGINT) AS kaiser,
               coalesce(min(rank) FILTER (WHERE v < par), max(rank) + 1) - 1 AS parallel,
               coalesce(min(rank) FILTER (WHERE NOT (v >= par AND rank < p AND coalesce(v >= line, false))), max(rank) + 1) - 1 AS optimal_coordinates,
               arg_max(rank, CASE WHEN ok THEN bend END) - 1 AS acceleration FROM g""",
)
def _(s: Survey) -> DataFrame:
    """The four rules on the sample sizes of the countries, taken as eigenvalues."""
    sizes = s.stored_cells.groupBy("iso_3166").agg(F.sum("yes").alias("n"))
    cubed = F.col("n").cast("double") * F.col("n") * F.col("n")
    mean = sizes.agg(F.avg(cubed)).scalar()
    placed = row_numbers(sizes, [F.col("n").desc(), F.col("iso_3166")], "rank")
    eigen = materialise(placed.select("rank", F.round(cubed / mean, 6).alias("eigenvalue")))
    return N.n_factors(eigen, eigen.select("rank", F.round(1.2 - 0.04 * F.col("rank"), 6).alias("parallel")))
