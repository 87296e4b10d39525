"""Joins, set operations, aggregates, windows and reshaping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.operators import aggregate as A
from pollspark.operators import shape as G
from pollspark.operators.dimension import corr_matrix, mean_correlation
from pollspark.operators.ranking import ACCURACY, approx_quantiles, median, quantiles
from pollspark.operators import relate as D
from pollspark.plans.fixtures import FINAL, PERIODS, QUESTION_COLS, QUESTIONS, Survey
from pollspark.plans.registry import query, r, rounded
from pollspark.session import materialise

_KEYS = ["source2", "iso_3166", "year2"]


def region_means(s: Survey) -> DataFrame:
    """Mean option per region, period and question."""
    return s.stored_cells.groupBy("iso_3166", "mergekey", "year2", "question").agg(
        (F.sum(F.col("yes") * F.col("option")) / F.sum("yes")).alias("avg_resp")
    )


@query(
    "d1_left_join",
    f"""WITH l AS (SELECT nullif(iso_3166, 'NATION_3') AS iso_3166, year2, mean FROM est_nat),
        e AS (SELECT nullif(iso_3166, 'NATION_3') AS code, emissions, mergekey FROM emissions)
        SELECT l.iso_3166, year2, {r("mean")} AS mean, mergekey, {r("emissions", 2)} AS emissions
        FROM l LEFT JOIN e ON l.iso_3166 IS NOT DISTINCT FROM e.code""",
)
def _(s: Survey) -> DataFrame:
    blank = F.nullif(F.col("iso_3166"), F.lit("NATION_3"))
    left = s.est_nat.select(blank.alias("iso_3166"), "year2", "mean")
    right = s.emissions.select(blank.alias("code"), "mergekey", "emissions")
    joined = D.left_join(left, right, [("iso_3166", "code")])
    return rounded(rounded(joined, "mean"), "emissions", digits=2)


@query(
    "d2_full_join",
    """WITH a AS (SELECT iso_3166, question, year2, CAST(sum(yes) AS BIGINT) AS regional FROM cells
                  WHERE year2 <> '2008-09' GROUP BY 1, 2, 3),
       b AS (SELECT iso_3166, question, year2, CAST(sum(yes) AS BIGINT) AS national FROM cells_nat
             WHERE year2 <> '2002-03' GROUP BY 1, 2, 3)
       SELECT iso_3166, question, year2, regional, national FROM a FULL JOIN b USING (iso_3166, question, year2)""",
)
def _(s: Survey) -> DataFrame:
    keys = ["iso_3166", "question", "year2"]
    a = s.stored_cells.where(F.col("year2") != "2008-09").groupBy(*keys).agg(F.sum("yes").alias("regional"))
    b = s.stored_nat.where(F.col("year2") != "2002-03").groupBy(*keys).agg(F.sum("yes").alias("national"))
    return D.full_join(a, b, keys)


@query(
    "d3_inner_and_natural_join",
    f"""SELECT a.iso_3166, a.year2, a.mergekey, {r("a.mean")} AS mean_x, {r("b.mean")} AS mean_y, {r("w.wt")} AS wt
        FROM est_reg a JOIN est_nat b ON a.iso_3166 = b.iso_3166 AND a.year2 = b.year2
        JOIN weights w ON a.iso_3166 = w.iso_3166 AND a.mergekey = w.mergekey""",
)
def _(s: Survey) -> DataFrame:
    nat = s.est_nat.select("iso_3166", "year2", "mean")
    reg = s.est_reg.select("iso_3166", "year2", "mergekey", "mean")
    both = D.inner_join(reg, nat, ["iso_3166", "year2"], ("_x", "_y"))
    natural = D.inner_join(both, s.weights.select("iso_3166", "mergekey", "wt"))
    return rounded(natural, "mean_x", "mean_y", "wt")


@query(
    "d4_fan_out_join",
    f"""WITH k AS (SELECT mergekey AS code, mergekey AS name FROM weights
                   UNION ALL SELECT mergekey, concat(mergekey, '*') FROM weights WHERE region_pop % 2 = 0)
        SELECT mergekey, year2, name, {r("mean")} AS mean FROM est_reg LEFT JOIN k ON mergekey = code""",
)
def _(s: Survey) -> DataFrame:
    single = s.weights.select(F.col("mergekey").alias("code"), F.col("mergekey").alias("name"))
    second = s.weights.where(F.col("region_pop") % 2 == 0).select(
        F.col("mergekey").alias("code"), F.concat("mergekey", F.lit("*")).alias("name")
    )
    key = single.unionByName(second)
    D.check_fan_out(s.est_reg, key, [("mergekey", "code")], limit=2)
    joined = D.left_join(s.est_reg, key, [("mergekey", "code")])
    return rounded(joined.select("mergekey", "year2", "name", "mean"), "mean")


def _even_regions(s: Survey) -> tuple[DataFrame, DataFrame]:
    """Answers by region and question, counted once, and the regions with an even number of them."""
    counts = materialise(A.tally(s.answers, "mergekey", "question"))
    return counts, counts.groupBy("mergekey").agg(F.sum("n").alias("total")).where(F.col("total") % 2 == 0)


@query(
    "d5_semi_join",
    """SELECT question, count(*) AS n FROM respp WHERE mergekey IN (
         SELECT mergekey FROM respp GROUP BY mergekey HAVING count(*) % 2 = 0) GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    counts, listed = _even_regions(s)
    return D.semi_join(counts, listed, "mergekey").groupBy("question").agg(F.sum("n").alias("n"))


@query(
    "d6_anti_join",
    """SELECT question, count(*) AS n FROM respp WHERE mergekey NOT IN (
         SELECT mergekey FROM respp GROUP BY mergekey HAVING count(*) % 2 = 0) GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    counts, listed = _even_regions(s)
    return D.anti_join(counts, listed, "mergekey").groupBy("question").agg(F.sum("n").alias("n"))


@query(
    "d6_coverage",
    """(SELECT mergekey, 'left' AS side FROM shapes EXCEPT SELECT mergekey, 'left' FROM cells WHERE question = 'R_F' AND option = 5)
       UNION ALL (SELECT mergekey, 'right' FROM cells WHERE question = 'R_F' AND option = 5
                  EXCEPT SELECT mergekey, 'right' FROM shapes WHERE mergekey NOT LIKE '%BUILDING')
       EXCEPT SELECT mergekey, 'left' FROM shapes WHERE mergekey LIKE '%BUILDING'""",
)
def _(s: Survey) -> DataFrame:
    left = s.shapes.where(~F.col("mergekey").endswith("BUILDING"))
    return D.coverage(left, s.cells.where((F.col("question") == "R_F") & (F.col("option") == 5)), "mergekey")


@query(
    "d7_group_aggregate_on_rows",
    f"""SELECT mergekey, year2, {r("mean - avg(mean) OVER (PARTITION BY iso_3166, year2)")} AS gap,
               count(*) OVER (PARTITION BY iso_3166, year2) AS regions FROM est_reg""",
)
def _(s: Survey) -> DataFrame:
    keys = ["iso_3166", "year2"]
    joined = D.with_group(s.est_reg, keys, F.avg("mean").alias("centre"), F.count(F.lit(1)).alias("regions"))
    return rounded(joined.select("mergekey", "year2", (F.col("mean") - F.col("centre")).alias("gap"), "regions"), "gap")


@query(
    "e1_union_all",
    """SELECT iso_3166, year2, question, option, yes FROM cells UNION ALL
       SELECT iso_3166, year2, question, option, yes FROM cells_nat""",
)
def _(s: Survey) -> DataFrame:
    cols = ["iso_3166", "year2", "question", "option", "yes"]
    return D.union_all(s.stored_cells.select(*cols), s.stored_nat.select(*cols))


@query(
    "e2_union_fill",
    """SELECT iso_3166, mergekey, year2, question, option, yes, size FROM cells UNION ALL
       SELECT iso_3166, NULL, year2, question, option, yes, size FROM cells_nat""",
)
def _(s: Survey) -> DataFrame:
    cols = ["iso_3166", "mergekey", "year2", "question", "option", "yes", "size"]
    return D.union_fill(s.stored_cells, s.stored_nat).select(*cols)


@query(
    "e3_union_distinct",
    "SELECT iso_3166, question, year2 FROM cells UNION SELECT iso_3166, question, year2 FROM cells_nat",
)
def _(s: Survey) -> DataFrame:
    cols = ["iso_3166", "question", "year2"]
    return D.union_distinct(s.stored_cells.select(*cols), s.stored_nat.select(*cols))


@query(
    "e4_set_difference",
    """SELECT iso_3166, question, year2, option FROM cells EXCEPT
       SELECT iso_3166, question, year2, option FROM cells_nat""",
)
def _(s: Survey) -> DataFrame:
    return D.set_difference(s.stored_cells, s.stored_nat.select("iso_3166", "question", "year2", "option"))


@query(
    "f1_sums",
    """SELECT question, CAST(sum(yes) AS BIGINT) AS yes, CAST(sum(size) AS BIGINT) AS size FROM cells GROUP BY 1
       UNION ALL SELECT NULL, CAST(sum(yes) AS BIGINT), CAST(sum(size) AS BIGINT) FROM cells""",
)
def _(s: Survey) -> DataFrame:
    sums = [F.sum("yes").alias("yes"), F.sum("size").alias("size")]
    by_question = s.cells.groupBy("question").agg(*sums)
    # The grand total adds up the group totals.
    return D.union_fill(by_question, by_question.agg(*sums))


@query(
    "f2_count_answers",
    "SELECT source2, iso_3166, year2, question, count(answer) AS size FROM resp_long GROUP BY 1, 2, 3, 4",
)
def _(s: Survey) -> DataFrame:
    return A.count_answers(s.wide, _KEYS, QUESTION_COLS)


@query(
    "f3_mean_answers",
    f"SELECT source2, iso_3166, year2, question, {r('avg(answer)')} AS avg_resp FROM resp_long GROUP BY 1, 2, 3, 4",
)
def _(s: Survey) -> DataFrame:
    return rounded(A.mean_answers(s.wide, _KEYS, QUESTION_COLS), "avg_resp")


@query(
    "f4_thickness",
    """SELECT iso_3166, count(DISTINCT concat(question, year2)) AS question_periods, count(DISTINCT year2) AS periods,
              count(DISTINCT question) AS questions FROM cells WHERE size > 3 GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return A.thickness(s.cells.where(F.col("size") > 3), "iso_3166", "year2", "question")


@query(
    "f5_distinct_counts",
    """SELECT count(DISTINCT source2) AS source2, count(DISTINCT iso_3166) AS iso_3166,
              count(DISTINCT mergekey) AS mergekey, count(DISTINCT question) AS question FROM respp""",
)
def _(s: Survey) -> DataFrame:
    return A.n_unique(s.answers, "source2", "iso_3166", "mergekey", "question")


@query(
    "f5_distinct_by_bitmaps",
    """SELECT question, count(DISTINCT mergekey) AS regioncode_int, count(DISTINCT iso_3166) AS iso_3166_int, count(DISTINCT year_int) AS year_int
       FROM cells GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    codes = ["regioncode_int", "iso_3166_int", "year_int"]
    return A.bitmap_distinct(A.bitmaps(s.coded_cells, ["question"], codes), ["question"], codes)


@query(
    "f6_question_coverage",
    """WITH c AS (SELECT source2, iso_3166, year2, question, count(answer) AS size FROM resp_long GROUP BY 1, 2, 3, 4)
       SELECT question, source2, count(DISTINCT iso_3166) AS ctry_n FROM c WHERE size <> 0 GROUP BY 1, 2
       HAVING count(DISTINCT iso_3166) >= 24""",
)
def _(s: Survey) -> DataFrame:
    sizes = A.count_answers(s.wide, _KEYS, QUESTION_COLS)
    return A.question_coverage(sizes, ["question", "source2"], "iso_3166", 24)


@query(
    "f7_region_obs",
    """SELECT mergekey, year_int, CAST(sum(CASE WHEN size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS obs
       FROM (SELECT DISTINCT continent_name, iso_3166, mergekey, year2, year_int, question, size FROM cells) t GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    return A.region_obs(s.cells, "mergekey", "year_int")


@query(
    "f7_country_obs",
    """WITH a AS (SELECT iso_3166, year_int, CASE WHEN sum(size) > 0 THEN 1 ELSE 0 END AS obs FROM cells GROUP BY 1, 2),
       b AS (SELECT iso_3166, year_int, CASE WHEN sum(size) > 0 THEN 1 ELSE 0 END AS obs FROM cells_nat GROUP BY 1, 2)
       SELECT iso_3166, year_int, obs FROM a FULL JOIN b USING (iso_3166, year_int, obs)""",
)
def _(s: Survey) -> DataFrame:
    return A.country_obs(s.stored_cells, s.stored_nat, "iso_3166", "year_int")


@query(
    "f8_question_obs",
    """WITH a AS (SELECT DISTINCT question, size, year_int, mergekey, iso_3166 FROM cells),
       b AS (SELECT DISTINCT question, size, year_int, iso_3166 FROM cells_nat)
       SELECT question, CAST(sum(CASE WHEN size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS obs
       FROM (SELECT question, size FROM a UNION ALL SELECT question, size FROM b) t GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return A.question_obs(s.stored_cells, s.stored_nat, "mergekey", "iso_3166", "year_int")


@query(
    "f9_total_responses",
    """WITH a AS (SELECT CAST(sum(size) AS BIGINT) AS n FROM (SELECT DISTINCT question, mergekey, size, year2 FROM cells) t),
       b AS (SELECT CAST(sum(size) AS BIGINT) AS n FROM (SELECT DISTINCT question, iso_3166, size, year2 FROM cells_nat) t)
       SELECT a.n AS regional, a.n + b.n AS total FROM a, b""",
)
def _(s: Survey) -> DataFrame:
    return A.total_responses(s.stored_cells, s.stored_nat, "mergekey", "iso_3166", "year2")


@query("f10_tally", "SELECT year2, iso_3166, question, count(*) AS n FROM respp GROUP BY 1, 2, 3")
def _(s: Survey) -> DataFrame:
    return A.tally(s.answers, "year2", "iso_3166", "question")


@query(
    "f11_quantiles_by_group",
    f"""SELECT iso_3166, {r("quantile_cont(concern, 0.05)", 4)} AS q5, {r("quantile_cont(concern, 0.25)", 4)} AS q25,
               {r("quantile_cont(concern, 0.5)", 4)} AS q50, {r("quantile_cont(concern, 0.95)", 4)} AS q95
        FROM outside GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    names = ["q5", "q25", "q50", "q95"]
    return rounded(quantiles(s.outside, "concern", [0.05, 0.25, 0.5, 0.95], ["iso_3166"], names), *names, digits=4)


@query(
    "f11_quantiles_global",
    f"""SELECT {r("quantile_cont(l_extendedprice, 0.0)", 4)} AS q0, {r("quantile_cont(l_extendedprice, 0.25)", 4)} AS q25,
               {r("quantile_cont(l_extendedprice, 0.5)", 4)} AS q50, {r("quantile_cont(l_extendedprice, 0.75)", 4)} AS q75,
               {r("quantile_cont(l_extendedprice, 1.0)", 4)} AS q100 FROM lineitem""",
)
def _(s: Survey) -> DataFrame:
    names = ["q0", "q25", "q50", "q75", "q100"]
    found = quantiles(s.table("lineitem"), "l_extendedprice", [0, 0.25, 0.5, 0.75, 1], names=names)
    return rounded(found, *names, digits=4)


@query(
    "f11_approximate_ranks",
    """SELECT iso_3166, count(concern) AS n, true AS q5, true AS q50, true AS q95 FROM outside GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    """Whether each approximate quantile has a rank within the promised bound."""
    probs = {"q5": 0.05, "q50": 0.5, "q95": 0.95}
    marks = materialise(approx_quantiles(s.outside, "concern", list(probs.values()), ["iso_3166"]))
    rows = D.left_join(s.outside.select("iso_3166", "concern"), marks, "iso_3166")
    n = F.count("concern")
    bound = n / ACCURACY + 1

    def near(name: str, p: float):
        below = F.sum((F.col("concern") < F.col(name)).cast("long"))
        upto = F.sum((F.col("concern") <= F.col(name)).cast("long"))
        return ((below <= p * n + bound) & (upto >= p * n - bound)).alias(name)

    return rows.groupBy("iso_3166").agg(n.alias("n"), *[near(name, p) for name, p in probs.items()])


@query("f11_quantiles_approximate")
def _(s: Survey) -> DataFrame:
    return approx_quantiles(s.outside, "concern", [0.05, 0.5, 0.95], ["iso_3166"])


@query(
    "f12_means",
    f"""SELECT {r("avg(gamma_raw)")} AS mean, {r("exp(avg(ln(gamma_raw)))")} AS geometric FROM item_gamma""",
)
def _(s: Survey) -> DataFrame:
    out = s.item_gamma.agg(F.avg("gamma_raw").alias("mean"), A.geo_mean("gamma_raw").alias("geometric"))
    return rounded(out, "mean", "geometric")


@query("f13_thresholds", "SELECT question, max(option) - 1 AS kmin1 FROM cells GROUP BY 1")
def _(s: Survey) -> DataFrame:
    return A.n_thresholds(s.stored_cells)


@query(
    "f14_regional_cv",
    f"""SELECT iso_3166, year2, {r("avg(mean)")} AS nat_regionmean, {r("stddev_samp(mean)")} AS nat_regionsd,
               {r("stddev_samp(mean) / avg(mean)")} AS nat_cv FROM est_reg GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    out = A.regional_cv(s.est_reg, ["iso_3166", "year2"], "mean")
    return rounded(out, "nat_regionmean", "nat_regionsd", "nat_cv")


@query(
    "f15_correlation_by_group",
    """WITH j AS (SELECT m.question, m.year2, m.iso_3166, m.avg_resp, e.mean FROM region_means m
                  JOIN est_reg e ON m.mergekey = e.mergekey AND m.year2 = e.year2)
       SELECT question, year2, count(DISTINCT iso_3166) AS ncountries, round_even(corr(avg_resp, mean), 2) + 0.0E0 AS corr
       FROM j GROUP BY 1, 2 HAVING count(DISTINCT iso_3166) > 1""",
)
def _(s: Survey) -> DataFrame:
    joined = D.inner_join(region_means(s), s.est_reg.select("mergekey", "year2", "mean"), ["mergekey", "year2"])
    return A.validation_corr(joined, "avg_resp", "mean", ["question", "year2"], "iso_3166")


_LONG = "SELECT mergekey, question, avg(avg_resp) AS val FROM region_means GROUP BY 1, 2"


def _item_matrix(s: Survey) -> DataFrame:
    long = region_means(s).groupBy("mergekey", "question").agg(F.avg("avg_resp").alias("val"))
    return corr_matrix(long, "mergekey", "question", "val", QUESTIONS)


@query(
    "f16_correlation_matrix",
    f"""WITH u AS ({_LONG}) SELECT a.question AS item_a, b.question AS item_b, {r("corr(a.val, b.val)")} AS corr
        FROM u a JOIN u b ON a.mergekey = b.mergekey GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    return rounded(_item_matrix(s), "corr")


@query(
    "f16_mean_correlation",
    f"""WITH u AS ({_LONG}), m AS (SELECT a.question AS item_a, b.question AS item, corr(a.val, b.val) AS c
               FROM u a JOIN u b ON a.mergekey = b.mergekey GROUP BY 1, 2)
        SELECT item, round_even(avg(c), 2) + 0.0E0 AS cor, concat(item, ': ', CAST(round_even(avg(c), 2) + 0.0E0 AS VARCHAR)) AS label
        FROM m GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return mean_correlation(_item_matrix(s))


@query("f17_range", "SELECT question, min(yes) AS low, max(yes) AS high FROM cells GROUP BY 1")
def _(s: Survey) -> DataFrame:
    return s.cells.groupBy("question").agg(F.min("yes").alias("low"), F.max("yes").alias("high"))


@query(
    "g1_standardise",
    f"SELECT mergekey, year2, {r('(mean - avg(mean) OVER ()) / stddev_samp(mean) OVER ()')} AS mean_std FROM est_reg",
)
def _(s: Survey) -> DataFrame:
    return rounded(G.standardise(s.est_reg.select("mergekey", "year2", "mean"), "mean").drop("mean"), "mean_std")


@query(
    "g2_standardise_by_group",
    f"""SELECT mergekey, year2, question, {r('''(avg_resp - avg(avg_resp) OVER (PARTITION BY question, year2))
               / stddev_samp(avg_resp) OVER (PARTITION BY question, year2)''')} AS scaled FROM region_means""",
)
def _(s: Survey) -> DataFrame:
    out = G.standardise(region_means(s), "avg_resp", ["question", "year2"], "scaled")
    return rounded(out.select("mergekey", "year2", "question", "scaled"), "scaled")


@query(
    "g3_rescale",
    f"""SELECT mergekey, year2, {r("(mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ())")} AS mean_scl
        FROM est_reg""",
)
def _(s: Survey) -> DataFrame:
    return rounded(G.rescale01(s.est_reg, "mean", "mean_scl").select("mergekey", "year2", "mean_scl"), "mean_scl")


@query(
    "g4_standardise_series",
    f"""WITH m AS (SELECT iso_3166, year2, question, avg(CASE WHEN answer >= 0 THEN answer END) AS yes FROM resp_long GROUP BY 1, 2, 3)
        SELECT iso_3166, year2, question, {r('''(yes - avg(yes) OVER (PARTITION BY question))
               / stddev_samp(yes) OVER (PARTITION BY question)''')} AS yes_scl FROM m""",
)
def _(s: Survey) -> DataFrame:
    from pollspark.operators.clean import null_negative

    means = A.mean_answers(null_negative(s.wide, QUESTION_COLS), ["iso_3166", "year2"], QUESTION_COLS)
    return rounded(G.standardise(means, "avg_resp", ["question"], "yes_scl").drop("avg_resp"), "yes_scl")


@query(
    "g5_last_observed",
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY mergekey ORDER BY year2 DESC) AS k FROM drifting WHERE obs > 0)
        SELECT mergekey, iso_3166, year2, {r("mean")} AS mean, obs FROM x WHERE k = 1 AND year2 <> '2008-09'""",
)
def _(s: Survey) -> DataFrame:
    rows = s.drifting.select("mergekey", "iso_3166", "year2", "mean", "obs")
    return rounded(G.last_observed(rows, "mergekey", "year2", FINAL), "mean")


def _ends_sql(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH x AS (SELECT iso_3166, mergekey, year2, mean,
                  row_number() OVER ({part}ORDER BY mean DESC, mergekey) AS hi,
                  row_number() OVER ({part}ORDER BY mean, mergekey) AS lo FROM est_reg WHERE year2 = '2008-09')
        SELECT iso_3166, mergekey, {r("mean")} AS mean, 'top' AS side FROM x WHERE hi <= 5
        UNION ALL SELECT iso_3166, mergekey, {r("mean")}, 'bottom' FROM x WHERE lo <= 5"""


def _ends(s: Survey, by: tuple[str, ...]) -> DataFrame:
    rows = s.est_reg.where(F.col("year2") == FINAL).select("iso_3166", "mergekey", "mean")
    return rounded(G.extremes(rows, "mean", 5, "mergekey", by), "mean")


@query("g6_extremes", _ends_sql(""))
def _(s: Survey) -> DataFrame:
    return _ends(s, ())


@query("g7_extremes_by_group", _ends_sql("iso_3166"))
def _(s: Survey) -> DataFrame:
    return _ends(s, ("iso_3166",))


@query("g8_sort", f"SELECT mergekey, year2, {r('mean')} AS mean, n FROM est_reg ORDER BY n DESC, mergekey, year2")
def _(s: Survey) -> DataFrame:
    rows = s.est_reg.select("mergekey", "year2", "mean", "n").orderBy(F.desc("n"), "mergekey", "year2")
    return rounded(rows, "mean")


@query(
    "g9_reorder_category",
    """WITH c AS (SELECT mergekey, median(avg_resp) AS m FROM region_means GROUP BY 1),
       k AS (SELECT mergekey, row_number() OVER (ORDER BY m, mergekey) AS rank FROM c)
       SELECT e.mergekey, e.year2, e.question, k.rank FROM region_means e JOIN k ON e.mergekey = k.mergekey""",
)
def _(s: Survey) -> DataFrame:
    return G.reorder(region_means(s).drop("iso_3166"), "mergekey", "avg_resp").drop("avg_resp")


@query(
    "g10_half_groups",
    """WITH k AS (SELECT mergekey, row_number() OVER (ORDER BY mean, mergekey) AS k, count(*) OVER () AS n FROM est_reg
                  WHERE year2 = '2008-09')
       SELECT mergekey, CASE WHEN k <= round_even(n / 2.0E0, 0) THEN 1 ELSE 2 END AS half FROM k""",
)
def _(s: Survey) -> DataFrame:
    rows = s.est_reg.where(F.col("year2") == FINAL).select("mergekey", "mean")
    return G.half_groups(rows, [F.col("mean"), F.col("mergekey")]).drop("mean")


@query(
    "g11_random_walk",
    f"""SELECT mergekey, year_int, {r("sum(mean - 0.5E0) OVER (PARTITION BY mergekey ORDER BY year_int) * 0.25E0")} AS walk
        FROM est_reg""",
)
def _(s: Survey) -> DataFrame:
    steps = s.est_reg.select("mergekey", "year_int", (F.col("mean") - 0.5).alias("step"))
    return rounded(G.random_walk(steps, ["mergekey"], "year_int", "step", F.lit(0.25), "walk").drop("step"), "walk")


@query("g12_integer_codes", "SELECT mergekey, iso_3166, regioncode_int FROM region_codes")
def _(s: Survey) -> DataFrame:
    return G.encode(s.stored_cells.select("mergekey", "iso_3166").distinct(), "mergekey", "regioncode_int")


@query(
    "g13_pivot_wider",
    "SELECT mergekey, "
    + ", ".join(f"{r(f'''max(CASE WHEN year2 = '{p}' THEN mean END)''')} AS \"{p}\"" for p in PERIODS)
    + " FROM est_reg GROUP BY 1",
)
def _(s: Survey) -> DataFrame:
    return rounded(G.pivot_wider(s.est_reg, ["mergekey"], "year2", "mean", PERIODS), *PERIODS)


@query("g14_pivot_longer", "SELECT l_orderkey, question, answer FROM resp_long")
def _(s: Survey) -> DataFrame:
    return G.pivot_longer(s.wide, ["l_orderkey"], QUESTION_COLS, "question", "answer")


@query(
    "g9_median_by_group",
    f"SELECT iso_3166, year2, {r('median(avg_resp)')} AS median FROM region_means GROUP BY 1, 2",
)
def _(s: Survey) -> DataFrame:
    return rounded(median(region_means(s), "avg_resp", ["iso_3166", "year2"]), "median")
