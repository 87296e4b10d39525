"""Period change, drift correction and model table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.operators import cells as I
from pollspark.operators import draws as R
from pollspark.operators import packed as P
from pollspark.operators import periods as H
from pollspark.operators import scores as S
from pollspark.operators.aggregate import n_thresholds
from pollspark.operators.fit import Fit, cell_gradient, fit, item_gradient, score_gradient, step_gradient
from pollspark.operators.ranking import row_numbers
from pollspark.operators.relate import inner_join, union_all
from pollspark.operators.shape import rescale01
from pollspark.plans.fixtures import FINAL, Survey
from pollspark.plans.registry import query, r, rounded
from pollspark.session import materialise


@query(
    "h1_period_change",
    f"""WITH w AS (SELECT iso_3166, max(CASE WHEN year2 = '2002-03' THEN mean_scl END) AS first,
                     max(CASE WHEN year2 = '2008-09' THEN mean_scl END) AS last FROM nat_scaled GROUP BY 1)
        SELECT iso_3166, {r("first")} AS first, {r("last")} AS last, {r("last - first")} AS delta,
               CASE WHEN last > first THEN 'increase' WHEN last < first THEN 'decrease' WHEN last = first THEN 'stable' END AS change
        FROM w""",
)
def _(s: Survey) -> DataFrame:
    return rounded(_change(s), "first", "last", "delta")


def _change(s: Survey) -> DataFrame:
    scaled = rescale01(s.est_nat, "mean", "mean_scl")
    return H.period_change(scaled, "iso_3166", "year2", "mean_scl", "2002-03", FINAL)


@query(
    "h1_direction_counts",
    """WITH w AS (SELECT iso_3166, max(CASE WHEN year2 = '2002-03' THEN mean_scl END) AS first,
                     max(CASE WHEN year2 = '2008-09' THEN mean_scl END) AS last FROM nat_scaled GROUP BY 1)
       SELECT CASE WHEN last > first THEN 'increase' WHEN last < first THEN 'decrease' WHEN last = first THEN 'stable' END AS change,
              count(*) AS n FROM w GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return H.direction_counts(_change(s))


_DRIFT = """l AS (SELECT *, row_number() OVER (PARTITION BY mergekey ORDER BY year2 DESC) AS k FROM drifting WHERE obs > 0),
    j AS (SELECT l.iso_3166, l.mergekey, l.year2, l.mean AS reg_mean, n.mean AS nat_mean, re.mean AS reg_end, ne.mean AS nat_end
          FROM l LEFT JOIN est_nat n ON l.iso_3166 = n.iso_3166 AND l.year2 = n.year2
          LEFT JOIN drifting re ON l.mergekey = re.mergekey AND re.year2 = '2008-09'
          LEFT JOIN est_nat ne ON l.iso_3166 = ne.iso_3166 AND ne.year2 = '2008-09'
          WHERE k = 1 AND l.year2 <> '2008-09'),
    d AS (SELECT *, nat_end - nat_mean AS dn, reg_end - reg_mean AS dr FROM j),
    flagged AS (SELECT *, dr - dn AS gap, CASE WHEN dr - dn IS NULL THEN NULL
                WHEN (abs(dr - dn) > 0.02 AND sign(dr) <> sign(dn)) OR (dr > 0 AND dn > 0 AND dr - dn > 0.02)
                  OR (dr < 0 AND dn < 0 AND dr - dn < -0.02) THEN 1 ELSE 0 END AS toobig FROM d)"""
_LINES = """lines AS (SELECT mergekey, reg_mean, dn, CAST(substring(year2, 1, 4) AS INT) AS y0,
                     unnest(generate_series(CAST(substring(year2, 1, 4) AS INT), 2008, 2)) AS y FROM flagged WHERE toobig = 1),
    interp AS (SELECT mergekey, concat(CAST(y AS VARCHAR), '-', lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')) AS year2,
                      reg_mean + dn * (y - y0) / (2008.0E0 - y0) AS mean_interp, y > y0 AS later FROM lines)"""


@query(
    "h2_drift_flags",
    f"""WITH {_DRIFT} SELECT iso_3166, mergekey, year2, {r("dn")} AS delta_nat, {r("dr")} AS delta_reg,
               {r("gap")} AS diff_deltas, toobig FROM flagged""",
)
def _(s: Survey) -> DataFrame:
    cols = ["iso_3166", "mergekey", "year2", "delta_nat", "delta_reg", "diff_deltas", "toobig"]
    return rounded(_flagged(s).select(*cols), "delta_nat", "delta_reg", "diff_deltas")


def _flagged(s: Survey) -> DataFrame:
    return H.flag_drift(s.drifting, s.est_nat, FINAL, tol=0.02)


@query(
    "h3_interpolation",
    f"WITH {_DRIFT}, {_LINES} SELECT mergekey, year2, {r('mean_interp')} AS mean_interp FROM interp",
)
def _(s: Survey) -> DataFrame:
    return rounded(H.interpolate(_flagged(s), end=2008).drop("later"), "mean_interp")


@query(
    "h4_apply_interpolation",
    f"""WITH {_DRIFT}, {_LINES}
        SELECT e.mergekey, e.year2, CASE WHEN later THEN 1 ELSE 0 END AS interpolated,
               {r("coalesce(mean_interp, mean)")} AS mean
        FROM drifting e LEFT JOIN interp i ON e.mergekey = i.mergekey AND e.year2 = i.year2""",
)
def _(s: Survey) -> DataFrame:
    est = s.drifting.select("mergekey", "year2", "mean")
    return rounded(H.apply_interpolation(est, H.interpolate(_flagged(s), end=2008)).drop("mean_interp"), "mean")


@query(
    "h5_long_series",
    """WITH q AS (SELECT question FROM cells WHERE size > 2 GROUP BY 1 HAVING count(DISTINCT year2) >= 3)
       SELECT question, year2, CAST(sum(yes) AS BIGINT) AS yes FROM cells WHERE size > 2 AND question IN (SELECT question FROM q)
       GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    kept = H.long_series(s.stored_cells.where(F.col("size") > 2), "question", "year2")
    return kept.groupBy("question", "year2").agg(F.sum("yes").alias("yes"))


@query("h5_series_length", "SELECT question, count(DISTINCT year2) AS n FROM cells GROUP BY 1")
def _(s: Survey) -> DataFrame:
    return H.series_length(s.cells, "question", "year2")


@query(
    "i1_ordinal_counts",
    """SELECT iso_3166, mergekey, year2, year_int, question, option, yes, size FROM cells""",
)
def _(s: Survey) -> DataFrame:
    return s.cells.drop("continent_name")


@query("i2_region_weights", f"SELECT iso_3166, mergekey, region_pop, {r('wt')} AS wt FROM weights")
def _(s: Survey) -> DataFrame:
    weights = materialise(s.weights)
    I.check_weights(weights, "iso_3166")
    return rounded(weights, "wt")


@query("i3_region_country", "SELECT DISTINCT mergekey, iso_3166 FROM cells")
def _(s: Survey) -> DataFrame:
    return I.region_country(s.stored_cells, "mergekey", "iso_3166")


@query(
    "i4_model_dimensions",
    """WITH b AS (SELECT iso_3166, question, option, year_int FROM cells WHERE size <> 0
                  UNION ALL SELECT iso_3166, question, option, year_int FROM cells_nat WHERE size <> 0)
       SELECT max(year_int) AS tt, max(option) AS k, count(DISTINCT iso_3166) AS c, count(DISTINCT question) AS j,
              (SELECT max(regioncode_int) FROM region_codes) AS r, (SELECT count(*) FROM cells) AS rtjk,
              (SELECT string_agg(CAST(kmin1 AS VARCHAR), ',' ORDER BY question_int) FROM (SELECT question_int, max(option) - 1 AS kmin1
               FROM b JOIN question_codes q ON b.question = q.question GROUP BY 1) t) AS thresholds,
              (SELECT count(*) FROM cells_nat) AS ctjk FROM b""",
)
def _(s: Survey) -> DataFrame:
    cells, nat = I.drop_empty_cells(s.coded_cells), I.drop_empty_cells(s.coded_nat)
    return I.model_dims(cells, nat, "iso_3166", "regioncode_int")


def _walks(s: Survey) -> DataFrame:
    country = s.est_nat.select("iso_3166", "year_int", F.col("mean").alias("country_alpha"))
    effect = s.est_reg.select("mergekey", "year_int", (F.col("mean") - 0.5).alias("region_effect"))
    return S.region_scores(country, effect, s.stored_cells.select("mergekey", "iso_3166").distinct())


@query(
    "i5_region_scores",
    f"""SELECT e.mergekey, e.year_int, {r("n.mean + e.mean - 0.5E0")} AS region_alpha
        FROM est_reg e JOIN est_nat n ON e.iso_3166 = n.iso_3166 AND e.year_int = n.year_int""",
)
def _(s: Survey) -> DataFrame:
    return rounded(_walks(s).select("mergekey", "year_int", "region_alpha"), "region_alpha")


@query(
    "i6_poststratify",
    f"""SELECT e.iso_3166, e.year_int, {r("sum((n.mean + e.mean - 0.5E0) * wt)")} AS country_poststrat
        FROM est_reg e JOIN est_nat n ON e.iso_3166 = n.iso_3166 AND e.year_int = n.year_int
        JOIN weights w ON e.mergekey = w.mergekey GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    return rounded(S.poststratify(_walks(s), s.weights, "region_alpha"), "country_poststrat")


_REPLICATE = """rep AS (SELECT iso_3166, mergekey, year_int, l_linenumber % 3 AS draw,
        avg((option - 1) / CASE WHEN question LIKE 'N%' THEN 2.0E0 ELSE 4.0E0 END) AS region_effect FROM respp GROUP BY 1, 2, 3, 4),
    walk AS (SELECT iso_3166, year_int, draw, avg(region_effect) AS country_alpha FROM rep GROUP BY 1, 2, 3)"""


@query(
    "i6_poststratify_per_draw",
    f"""WITH {_REPLICATE}
        SELECT p.iso_3166, p.year_int, p.draw, {r("sum((region_effect + country_alpha) * wt)")} AS country_poststrat
        FROM rep p JOIN walk w ON p.iso_3166 = w.iso_3166 AND p.year_int = w.year_int AND p.draw = w.draw
        JOIN weights g ON p.mergekey = g.mergekey GROUP BY 1, 2, 3""",
)
def _(s: Survey) -> DataFrame:
    # Replicates by line number stand for draws of the two walks.
    score = (F.col("option") - 1) / F.when(F.col("question").startswith("N"), 2.0).otherwise(4.0)
    keys = ["iso_3166", "mergekey", "year_int", (F.col("l_linenumber") % 3).alias("draw")]
    effect = materialise(s.answers.groupBy(*keys).agg(F.avg(score).alias("region_effect")))
    walk = effect.groupBy("iso_3166", "year_int", "draw").agg(F.avg("region_effect").alias("country_alpha"))
    regions = effect.select("mergekey", "iso_3166").distinct()
    draws = S.region_scores(walk, effect.drop("iso_3166"), regions, ("year_int", "draw"))
    return rounded(S.poststratify(draws, s.weights, "region_alpha", ("year_int", "draw")), "country_poststrat")


@query(
    "i6_poststratify_packed",
    f"""WITH {_REPLICATE}
        SELECT p.iso_3166, p.year_int, CAST(p.draw AS BIGINT) AS draw, {r("sum((region_effect + country_alpha) * wt)")} AS country_poststrat
        FROM rep p JOIN walk w ON p.iso_3166 = w.iso_3166 AND p.year_int = w.year_int AND p.draw = w.draw
        JOIN weights g ON p.mergekey = g.mergekey GROUP BY 1, 2, 3""",
)
def _(s: Survey) -> DataFrame:
    """The same draws as arrays, in blocks of two."""
    score = (F.col("option") - 1) / F.when(F.col("question").startswith("N"), 2.0).otherwise(4.0)
    keys = ["iso_3166", "mergekey", "year_int", (F.col("l_linenumber") % 3).alias("draw")]
    effect = materialise(s.answers.groupBy(*keys).agg(F.avg(score).alias("region_effect")))
    walk = effect.groupBy("iso_3166", "year_int", "draw").agg(F.avg("region_effect").alias("country_alpha"))
    regions = effect.select("mergekey", "iso_3166").distinct()
    effects = P.pack_draws(effect, ["mergekey", "year_int"], "draw", "region_effect", 2)
    scores = P.packed_region_scores(P.pack_draws(walk, ["iso_3166", "year_int"], "draw", "country_alpha", 2), effects, regions)
    found = P.packed_poststratify(scores, s.weights, "region_alpha")
    return rounded(P.unpack_draws(found, "country_poststrat", block=2), "country_poststrat")


_ITEMS = """g AS (SELECT question, kmin1, gamma_raw / (SELECT exp(avg(ln(gamma_raw))) FROM item_gamma) AS gamma FROM item_gamma),
    b0 AS (SELECT b.question, k, kmin1, (2 * beta_raw - (kmin1 + 1)) / CASE WHEN kmin1 <> 1 THEN kmin1 - 1 ELSE 1 END AS loose
           FROM item_beta b JOIN item_gamma i ON b.question = i.question),
    c0 AS (SELECT avg(m) AS centre FROM (SELECT avg(loose) AS m FROM b0 WHERE k <= kmin1 GROUP BY question) t),
    b AS (SELECT question, k, kmin1, loose - centre AS beta FROM b0, c0)"""


@query(
    "i7_centre_cutpoints",
    f"WITH {_ITEMS} SELECT question, k, k <= kmin1 AS used, {r('beta')} AS beta FROM b",
)
def _(s: Survey) -> DataFrame:
    out = S.centre_cutpoints(s.item_beta, n_thresholds(s.stored_cells))
    return rounded(out.select("question", "k", "used", "beta"), "beta")


@query("i8_scale_discrimination", f"WITH {_ITEMS} SELECT question, {r('gamma')} AS gamma FROM g")
def _(s: Survey) -> DataFrame:
    return rounded(S.scale_discrimination(s.item_gamma).select("question", "gamma"), "gamma")


def _loglik_sql(table: str, est: str, key: str) -> str:
    return f"""WITH {_ITEMS},
        x AS (SELECT c.question, option, yes, g.kmin1, gamma, gamma * (e.mean - lo.beta) AS a, gamma * (e.mean - up.beta) AS z
              FROM {table} c JOIN {est} e ON c.{key} = e.{key} AND c.year_int = e.year_int JOIN g ON c.question = g.question
              LEFT JOIN b lo ON lo.question = c.question AND lo.k = option - 1
              LEFT JOIN b up ON up.question = c.question AND up.k = option),
        p AS (SELECT question, yes, CASE WHEN option = 1 THEN -ln(1 + exp(z)) WHEN option = kmin1 + 1 THEN -ln(1 + exp(-a))
                     ELSE ln(1 / (1 + exp(-a)) - 1 / (1 + exp(-z))) END AS ll FROM x)"""


def _items(s: Survey) -> tuple[DataFrame, DataFrame]:
    gamma = S.scale_discrimination(s.item_gamma)
    beta = S.centre_cutpoints(s.item_beta, n_thresholds(s.stored_cells)).where("used").select("question", "k", "beta")
    return gamma, beta


@query(
    "i9_loglik_regions",
    f"{_loglik_sql('cells', 'est_reg', 'mergekey')} SELECT count(*) AS cells, {r('sum(yes * ll)', 3)} AS loglik FROM p",
)
def _(s: Survey) -> DataFrame:
    gamma, beta = _items(s)
    scores = s.est_reg.select("mergekey", "year_int", "mean")
    total = S.ordinal_loglik(s.stored_cells.drop("iso_3166"), scores, "mean", ["mergekey", "year_int"], gamma, beta)
    return rounded(total, "loglik", digits=3)


@query(
    "i9_loglik_nations",
    f"{_loglik_sql('cells_nat', 'est_nat', 'iso_3166')} SELECT count(*) AS cells, {r('sum(yes * ll)', 3)} AS loglik FROM p",
)
def _(s: Survey) -> DataFrame:
    gamma, beta = _items(s)
    scores = s.est_nat.select("iso_3166", "year_int", "mean")
    total = S.ordinal_loglik(s.stored_nat, scores, "mean", ["iso_3166", "year_int"], gamma, beta)
    return rounded(total, "loglik", digits=3)


@query(
    "i9_cell_probabilities",
    f"""{_loglik_sql('cells', 'est_reg', 'mergekey')}
        SELECT question, count(*) AS n, {r("sum(yes * ll) / sum(yes)")} AS mean_ll FROM p GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    gamma, beta = _items(s)
    scores = s.est_reg.select("mergekey", "year_int", "mean")
    cells = S.cell_probabilities(s.stored_cells.drop("iso_3166"), scores, "mean", ["mergekey", "year_int"], gamma, beta)
    per_question = cells.groupBy("question").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("yes") * F.col("ll")) / F.sum("yes")).alias("mean_ll")
    )
    return rounded(per_question, "mean_ll")


_HALF_LOG_2PI = "0.9189385332046727E0"


@query(
    "i10_log_prior",
    f"""WITH c AS (SELECT year_int, mean AS x, CASE WHEN year_int = 1 THEN 5.0E0 ELSE 1.0E0 END AS sd FROM est_nat),
        g AS (SELECT year_int, mean AS x, CASE WHEN year_int = 1 THEN 3.0E0 ELSE 1.0E0 END AS sd FROM est_reg),
        st AS (SELECT (SELECT avg(mean) FROM est_nat) AS cs, (SELECT avg(mean) FROM est_reg) AS rs),
        b AS (SELECT beta_raw - k - CASE WHEN k > kmin1 THEN 100 ELSE 0 END AS d, CASE WHEN kmin1 <> 1 THEN kmin1 - 1 ELSE 1 END AS sd
              FROM item_beta b JOIN item_gamma i ON b.question = i.question)
        SELECT 'country_steps' AS block, {r(f"sum(-0.5E0 * x * x / (sd * sd) - ln(sd) - {_HALF_LOG_2PI})", 4)} AS log_prior FROM c
        UNION ALL SELECT 'region_steps', {r(f"sum(-0.5E0 * x * x / (sd * sd) - ln(sd) - {_HALF_LOG_2PI})", 4)} FROM g
        UNION ALL SELECT 'country_step', {r("2 * ln(8) + ln(cs) - 8 * cs", 4)} FROM st
        UNION ALL SELECT 'region_step', {r("ln(8) - 8 * rs", 4)} FROM st
        UNION ALL SELECT 'gamma_raw', {r("sum(ln(0.55E0) - 0.55E0 * gamma_raw)", 4)} FROM item_gamma
        UNION ALL SELECT 'beta_raw', {r(f"sum(-0.5E0 * d * d / (sd * sd) - ln(sd) - {_HALF_LOG_2PI})", 4)} FROM b""",
)
def _(s: Survey) -> DataFrame:
    sizes = s.est_nat.agg(F.avg("mean").alias("country_step")).select(
        "country_step", s.est_reg.agg(F.avg("mean").alias("m")).scalar().alias("region_step")
    )
    blocks = S.log_prior(
        s.est_nat.select("year_int", F.col("mean").alias("step")),
        s.est_reg.select("year_int", F.col("mean").alias("step")),
        sizes,
        s.item_gamma,
        s.item_beta,
        n_thresholds(s.stored_cells),
    )
    return rounded(blocks, "log_prior", digits=4)


@query(
    "i11_draw_summary",
    f"""WITH m AS (SELECT variable, median(value) AS med FROM draws GROUP BY 1)
        SELECT d.variable, {r("avg(value)")} AS mean, {r("any_value(med)")} AS median, {r("stddev_samp(value)")} AS sd,
               {r("1.4826E0 * median(abs(value - med))")} AS mad, {r("quantile_cont(value, 0.05)")} AS q5,
               {r("quantile_cont(value, 0.95)")} AS q95
        FROM draws d JOIN m ON d.variable = m.variable GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return rounded(R.summarise_draws(s.draw_values.select("variable", "value")), "mean", "median", "sd", "mad", "q5", "q95")


@query(
    "i12_split_rhat",
    f"""WITH s AS (SELECT variable, chain, count(*) AS n FROM draws GROUP BY 1, 2),
        d AS (SELECT d.variable, d.chain, iteration, value, n // 2 AS h, n FROM draws d JOIN s ON d.variable = s.variable AND d.chain = s.chain),
        p AS (SELECT variable, chain, iteration > n - h AS second, avg(value) AS mu, var_samp(value) AS v, count(*) * 1.0E0 AS h FROM d
              WHERE iteration <= h OR iteration > n - h GROUP BY 1, 2, 3),
        g AS (SELECT variable AS name, sum(h * mu) / sum(h) AS mid FROM p GROUP BY 1),
        w AS (SELECT variable, sum((h - 1) * v) / sum(h - 1) AS within, avg(h) AS h,
                     sum(h * (mu - mid) * (mu - mid)) / ((count(*) - 1) * avg(h)) AS between FROM p JOIN g ON variable = name GROUP BY 1)
        SELECT variable, {r("sqrt(((h - 1.0E0) / h * within + between) / within)")} AS rhat FROM w""",
)
def _(s: Survey) -> DataFrame:
    return rounded(R.split_rhat(s.draws), "rhat")


@query(
    "i12_effective_size",
    f"""WITH s AS (SELECT variable, chain, count(*) AS n FROM draws GROUP BY 1, 2),
        d AS (SELECT d.variable, d.chain, iteration, value, n // 2 AS h, n FROM draws d JOIN s ON d.variable = s.variable AND d.chain = s.chain),
        h AS (SELECT variable, chain * 2 + CAST(iteration > n - h AS INT) AS half, CASE WHEN iteration > n - h THEN iteration - (n - h) ELSE iteration END AS pos,
                     value FROM d WHERE iteration <= h OR iteration > n - h),
        m AS (SELECT variable, half, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM h GROUP BY 1, 2),
        g AS (SELECT variable AS name, sum(n * m) / sum(n) AS mid FROM m GROUP BY 1),
        p AS (SELECT variable, min(n) AS shortest, sum(n) AS total, sum((n - 1) * v) / sum(n - 1) AS within, avg(n) AS n,
                     sum(n * (m - mid) * (m - mid)) / ((count(*) - 1) * avg(n)) AS between FROM m JOIN g ON variable = name GROUP BY 1),
        x AS (SELECT h.variable, h.half, pos, value - m AS x FROM h JOIN m ON h.variable = m.variable AND h.half = m.half),
        l AS (SELECT a.variable, b.pos - a.pos AS lag, sum(a.x * b.x) AS s FROM x a JOIN x b ON a.variable = b.variable AND a.half = b.half
              AND b.pos >= a.pos GROUP BY 1, 2),
        c AS (SELECT l.variable, lag, shortest, CASE WHEN lag = 0 THEN 1.0E0
                     ELSE 1 - (within - s / total) / ((n - 1) / n * within + between) END AS rho
              FROM l JOIN p ON l.variable = p.variable WHERE lag < shortest),
        k AS (SELECT variable, lag // 2 AS k, sum(rho) AS pair, max(CASE WHEN lag % 2 = 0 THEN rho END) AS even FROM c
              GROUP BY variable, shortest, lag // 2 HAVING count(*) = 2 AND (lag // 2 = 0 OR 2 * (lag // 2) < shortest - 3)),
        e AS (SELECT *, min(pair) OVER (PARTITION BY variable ORDER BY k ROWS UNBOUNDED PRECEDING) AS low,
                     min(CASE WHEN pair < 0 THEN k END) OVER (PARTITION BY variable) AS stop, max(k) OVER (PARTITION BY variable) AS last FROM k),
        t AS (SELECT variable, sum(CASE WHEN k < coalesce(stop, last) THEN low ELSE 0 END) AS total,
                     max(CASE WHEN k = stop THEN greatest(even, 0) WHEN stop IS NULL AND k = last THEN even END) AS even FROM e GROUP BY 1)
        SELECT t.variable, {r("p.total / greatest(-1 + 2 * t.total + even, 1 / log10(p.total))", 3)} AS ess FROM t JOIN p ON t.variable = p.variable""",
)
def _(s: Survey) -> DataFrame:
    return rounded(R.effective_size(materialise(R.split_chains(s.draws))), "ess", digits=3)


@query("i12_convergence")
def _(s: Survey) -> DataFrame:
    return R.convergence(s.draws)


@query(
    "i13_gradient",
    f"""WITH {_ITEMS},
        x AS (SELECT c.mergekey, c.year_int, option, yes, g.kmin1, gamma, 1 / (1 + exp(-gamma * (e.mean - lo.beta))) AS a,
                     1 / (1 + exp(-gamma * (e.mean - up.beta))) AS z
              FROM cells c JOIN est_reg e ON c.mergekey = e.mergekey AND c.year_int = e.year_int JOIN g ON c.question = g.question
              LEFT JOIN b lo ON lo.question = c.question AND lo.k = option - 1
              LEFT JOIN b up ON up.question = c.question AND up.k = option)
        SELECT mergekey, year_int,
               {r("sum(yes * CASE WHEN option = 1 THEN ln(1 - z) WHEN option = kmin1 + 1 THEN ln(a) ELSE ln(a - z) END)", 4)} AS loglik,
               {r("""sum(yes * gamma * CASE WHEN option = 1 THEN -z WHEN option = kmin1 + 1 THEN 1 - a
                         ELSE (a * (1 - a) - z * (1 - z)) / (a - z) END)""", 4)} AS d_score
        FROM x GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    gamma, beta = _items(s)
    scores = s.est_reg.select("mergekey", "year_int", "mean")
    found = score_gradient(s.stored_cells.drop("iso_3166"), scores, "mean", ["mergekey", "year_int"], gamma, beta)
    return rounded(found, "loglik", "d_score", digits=4)


# Slopes of a cell's log-likelihood; NULL marks a cutpoint that the option does not have.
_SLOPES = f"""{_ITEMS},
        x AS (SELECT c.*, g.kmin1, gamma, e.mean AS score, e.mean - lo.beta AS sl, e.mean - up.beta AS su,
                     1 / (1 + exp(-gamma * (e.mean - lo.beta))) AS a, 1 / (1 + exp(-gamma * (e.mean - up.beta))) AS z
              FROM cells c JOIN est_reg e ON c.mergekey = e.mergekey AND c.year_int = e.year_int JOIN g ON c.question = g.question
              LEFT JOIN b lo ON lo.question = c.question AND lo.k = option - 1
              LEFT JOIN b up ON up.question = c.question AND up.k = option),
        y AS (SELECT *, CASE WHEN option = 1 THEN NULL WHEN option = kmin1 + 1 THEN 1 - a ELSE a * (1 - a) / (a - z) END AS da,
                     CASE WHEN option = 1 THEN z WHEN option = kmin1 + 1 THEN NULL ELSE z * (1 - z) / (a - z) END AS dz FROM x)"""


def _cell_slopes(s: Survey) -> DataFrame:
    gamma, beta = _items(s)
    scores = s.est_reg.select("mergekey", "year_int", "mean")
    return cell_gradient(s.stored_cells, scores, "mean", ["mergekey", "year_int"], gamma, beta)


@query(
    "i13_item_gradient",
    f"""WITH {_SLOPES},
        u AS (SELECT question, NULL AS k, yes * (coalesce(da * sl, 0) - coalesce(dz * su, 0)) AS d FROM y
              UNION ALL SELECT question, option - 1, -yes * gamma * da FROM y WHERE da IS NOT NULL
              UNION ALL SELECT question, option, yes * gamma * dz FROM y WHERE dz IS NOT NULL)
        SELECT question, CAST(k AS INT) AS k, {r("sum(d)", 4)} AS slope FROM u GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    return rounded(item_gradient(_cell_slopes(s)), "slope", digits=4)


@query(
    "i13_step_gradient",
    f"""WITH {_SLOPES},
        v AS (SELECT yes * gamma * (coalesce(da, 0) - coalesce(dz, 0)) AS d, score - n.mean AS effect, n.mean AS walk
              FROM y JOIN est_nat n ON y.iso_3166 = n.iso_3166 AND y.year_int = n.year_int)
        SELECT 'country' AS step, {r("sum(d * walk)", 4)} AS slope FROM v
        UNION ALL SELECT 'region', {r("sum(d * effect)", 4)} FROM v""",
)
def _(s: Survey) -> DataFrame:
    gamma, beta = _items(s)
    on = ["mergekey", "year_int"]
    slopes = score_gradient(s.stored_cells.drop("iso_3166"), s.est_reg.select(*on, "mean"), "mean", on, gamma, beta)
    walks = s.est_nat.select("iso_3166", "year_int", F.col("mean").alias("walk"))
    placed = inner_join(s.est_reg.select("iso_3166", *on, "mean"), walks, ["iso_3166", "year_int"])
    rows = materialise(inner_join(slopes, placed.withColumn("effect", F.col("mean") - F.col("walk")), on))
    both = [step_gradient(rows, c).withColumn("step", F.lit(n)) for n, c in (("country", "walk"), ("region", "effect"))]
    return rounded(union_all(*[b.select("step", "slope") for b in both]), "slope", digits=4)


def fitted(s: Survey) -> Fit:
    """The posterior mode over all cells of the survey."""
    cells = materialise(s.coded_cells.select("regioncode_int", "iso_3166_int", "year_int", "question_int", "option", "yes"))
    nat = s.coded_nat.select("iso_3166_int", "year_int", "question_int", "option", "yes")
    region_map = cells.select("regioncode_int", "iso_3166_int").distinct()
    weights = inner_join(s.region_codes, s.weights, ["mergekey"]).select("regioncode_int", "wt")
    return fit(cells, nat, region_map, weights)


@query("i13_posterior_mode")
def _(s: Survey) -> DataFrame:
    return fitted(s).variables()


def _periods(s: Survey) -> DataFrame:
    return S.item_lookup(s.stored_cells, s.stored_nat, "year_int", "year2")


@query("i14_decode_regions", f"SELECT mergekey, iso_3166, year2, {r('mean')} AS mean FROM est_reg")
def _(s: Survey) -> DataFrame:
    regions = inner_join(s.region_codes, s.stored_cells.select("mergekey", "iso_3166").distinct(), ["mergekey"])
    out = S.decode_region(s.summary, regions, _periods(s))
    return rounded(out.select("mergekey", "iso_3166", "year2", "mean"), "mean")


@query("i14_decode_countries", f"SELECT iso_3166, year2, {r('mean')} AS mean FROM est_nat")
def _(s: Survey) -> DataFrame:
    out = S.decode_country(s.summary, s.country_codes, _periods(s))
    return rounded(out.select("iso_3166", "year2", "mean"), "mean")


@query(
    "i14_decode_questions",
    f"SELECT question, {r('gamma_raw')} AS mean, {r('gamma_raw - 0.1E0')} AS q5, {r('gamma_raw + 0.1E0')} AS q95 FROM item_gamma",
)
def _(s: Survey) -> DataFrame:
    out = S.decode_question(s.summary, s.question_codes)
    return rounded(out.select("question", "mean", "q5", "q95"), "mean", "q5", "q95")


_USED = f"""SELECT question_int, CAST(b.k AS INT) AS option, {r("beta_raw")} AS mean FROM item_beta b
    JOIN question_codes q ON b.question = q.question JOIN item_gamma g ON g.question = b.question WHERE b.k <= g.kmin1"""


@query("i15_decode_cutpoints", _USED)
def _(s: Survey) -> DataFrame:
    out = S.decode_cutpoints(s.summary, s.coded_cells)
    return rounded(out.select("question_int", "option", "mean"), "mean")


@query("i15_decode_cutpoint_sequence", _USED)
def _(s: Survey) -> DataFrame:
    # The sequence form numbers all used cutpoints in one run.
    limits = s.coded_cells.groupBy("question_int").agg((F.max("option") - 1).alias("kmin1"))
    coded = inner_join(inner_join(s.item_beta, s.question_codes, ["question"]), limits, ["question_int"])
    used = coded.where(F.col("k") <= F.col("kmin1"))
    run = row_numbers(used, [F.col("question_int"), F.col("k")], "i")
    variable = F.concat(F.lit("beta["), F.col("i").cast("string"), F.lit("]"))
    summary = run.select(variable.alias("variable"), F.col("beta_raw").alias("mean"))
    out = S.decode_cutpoints(summary, s.coded_cells, sequence=True)
    return rounded(out.select("question_int", "option", "mean"), "mean")
