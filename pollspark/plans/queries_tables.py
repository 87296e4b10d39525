"""Sources, cleaning and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.functions import columns as C
from pollspark.operators import clean
from pollspark.operators.aggregate import tally
from pollspark.operators.cells import merged_cells, store_cells
from pollspark.operators.relate import union_all
from pollspark.plans.fixtures import QUESTION_COLS, Survey
from pollspark.plans.registry import query, r, rounded, scratch
from pollspark.sources import tables as T

_KEYS = {
    "lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey",
    "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id",
    "embeddings": "vec_id",
}
_CONTINENTS = {"AMERICA": "Americas", "ASIA": "Asia, Oceania", "MIDDLE EAST": "Asia, Oceania", "EUROPE": "Europe, Eurasia"}


@query(
    "a1_table_profile",
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows, CAST(min({k}) AS BIGINT) AS low, CAST(max({k}) AS BIGINT) AS high FROM {t}"
        for t, k in _KEYS.items()
    ),
)
def _(s: Survey) -> DataFrame:
    return union_all(
        *[
            s.table(t).agg(
                F.lit(t).alias("name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.min(k).cast("long").alias("low"),
                F.max(k).cast("long").alias("high"),
            )
            for t, k in _KEYS.items()
        ]
    )


@query("a2_csv_scan", f"SELECT iso_3166, {r('exposure')} AS exposure FROM exposure")
def _(s: Survey) -> DataFrame:
    path = scratch(s.spark, "exposure")
    T.write_csv(s.exposure, path)
    return rounded(T.read_csv(s.spark, path, "iso_3166 string, exposure double"), "exposure")


@query("a3_attribute_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(s: Survey) -> DataFrame:
    return T.load_table(s.spark, s.sf_dir, "nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query(
    "a4_csv_round_trip",
    f"""SELECT e.iso_3166, year2, {r("mean")} AS mean, {r("exposure")} AS exposure
        FROM est_nat e JOIN exposure x ON e.iso_3166 = x.iso_3166 WHERE year2 IN ('2002-03', '2008-09')""",
)
def _(s: Survey) -> DataFrame:
    path = scratch(s.spark, "estimates")
    kept = s.est_nat.where(F.col("year2").isin("2002-03", "2008-09")).join(s.exposure, "iso_3166")
    T.write_csv(kept.select("iso_3166", "year2", "mean", "exposure"), path, header=False)
    back = T.read_csv(s.spark, path, "iso_3166 string, year2 string, mean double, exposure double", header=False)
    return rounded(back, "mean", "exposure")


@query("a5_cell_waves", "SELECT iso_3166, mergekey, year2, year_int, question, option, yes, size FROM cells")
def _(s: Survey) -> DataFrame:
    """Cells of two waves by source, the first of which comes in twice."""
    answers = s.answers.where(F.col("orderstatus") != "P")
    folder, geo, period = scratch(s.spark, "waves"), ["iso_3166", "mergekey"], ["year2", "year_int"]
    late = F.coalesce(F.col("source2") >= "3", F.lit(False))
    for wave in (answers.where(late), answers.where(~late), answers.where(late)):
        store_cells(wave, folder, geo, period, "source2")
    return merged_cells(s.spark, folder, geo, period)


@query("a5_table_round_trip", "SELECT iso_3166, mergekey, year2, question, option, yes, size FROM cells")
def _(s: Survey) -> DataFrame:
    root = scratch(s.spark, "bundle")
    T.write_table(s.cells.select("iso_3166", "mergekey", "year2", "question", "option", "yes", "size"), root, "cells")
    return T.load_table(s.spark, root, "cells")


@query(
    "a6_variant_pruning",
    """SELECT question, count(*) AS n_cells, CAST(sum(yes) AS BIGINT) AS yes FROM cells
       WHERE question LIKE 'N%' GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    root, short, long = scratch(s.spark, "bundle"), T.variant("walk", "2yr", "short"), T.variant("walk", "2yr", "long")
    is_short = F.col("question").startswith("N")
    T.write_table(s.cells.where(is_short), root, "cells", short)
    T.write_table(s.cells.where(~is_short), root, "cells", long)
    kept = T.load_table(s.spark, root, "cells", short)
    return kept.groupBy("question").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("yes").alias("yes"))


@query(
    "b1_select_rename",
    "SELECT l_orderkey AS respondent, iso_3166 AS country, source2 AS source, year2 AS year FROM resp_wide",
)
def _(s: Survey) -> DataFrame:
    renamed = s.wide.withColumnsRenamed(
        {"l_orderkey": "respondent", "iso_3166": "country", "source2": "source", "year2": "year"}
    )
    return renamed.drop("mergekey", *QUESTION_COLS)


@query(
    "b2_complete_cases",
    "SELECT l_orderkey, q_a_f, q_n_o FROM resp_wide WHERE q_a_f IS NOT NULL AND q_n_o IS NOT NULL",
)
def _(s: Survey) -> DataFrame:
    return clean.complete_cases(s.wide.select("l_orderkey", "q_a_f", "q_n_o"))


@query(
    "b3_any_answered",
    "SELECT source2, count(*) AS n FROM resp_wide WHERE coalesce(q_a_f, q_a_o, q_n_f) IS NOT NULL GROUP BY 1",
)
def _(s: Survey) -> DataFrame:
    return tally(clean.any_answered(s.wide, ["q_a_f", "q_a_o", "q_n_f"]), "source2")


@query(
    "b4_predicates",
    """SELECT iso_3166, count(*) AS n FROM respp
       WHERE year >= 2003 AND question IN ('A_F', 'N_O') AND option IS NOT NULL
         AND (source2 = '1-URGENT' OR option > 3) AND NOT orderstatus = 'P' GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    c = F.col
    kept = s.answers.where(
        (c("year") >= 2003)
        & c("question").isin("A_F", "N_O")
        & c("option").isNotNull()
        & ((c("source2") == "1-URGENT") | (c("option") > 3))
        & ~(c("orderstatus") == "P")
    )
    return tally(kept, "iso_3166")


@query(
    "b5_regex_predicate",
    """SELECT mergekey, CAST(sum(yes) AS BIGINT) AS yes FROM cells
       WHERE NOT regexp_matches(mergekey, '.BUILD') GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return s.cells.where(~F.col("mergekey").rlike(".BUILD")).groupBy("mergekey").agg(F.sum("yes").alias("yes"))


@query("b6_columns_by_name", "SELECT l_orderkey, q_a_f, q_a_o, q_n_f, q_n_o FROM resp_wide")
def _(s: Survey) -> DataFrame:
    return s.wide.select("l_orderkey", *clean.cols_like(s.wide, "_a_", "_n_"))


@query("b7_distinct_rows", "SELECT DISTINCT iso_3166, mergekey, year2, year_int FROM cells")
def _(s: Survey) -> DataFrame:
    return s.cells.select("iso_3166", "mergekey", "year2", "year_int").distinct()


@query(
    "b8_null_negative",
    "SELECT l_orderkey, "
    + ", ".join(f"CASE WHEN {c} >= 0 THEN {c} END AS {c}" for c in QUESTION_COLS)
    + " FROM resp_wide",
)
def _(s: Survey) -> DataFrame:
    return clean.null_negative(s.wide.select("l_orderkey", *QUESTION_COLS), QUESTION_COLS)


@query(
    "b9_default_for_missing",
    f"""SELECT s.iso_3166, s.mergekey, coalesce(continent_name, 'Missing') AS continent_name,
               coalesce({r("exposure")}, 0.0E0) AS exposure
        FROM shapes s LEFT JOIN exposure e ON s.iso_3166 = e.iso_3166""",
)
def _(s: Survey) -> DataFrame:
    joined = s.shapes.join(rounded(s.exposure, "exposure"), "iso_3166", "left")
    return joined.withColumn("continent_name", F.coalesce("continent_name", F.lit("Missing"))).fillna({"exposure": 0.0})


@query(
    "b10_try_cast",
    """SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 2 = 0 THEN replace(p_brand, 'Brand#', '') ELSE p_brand END AS INT)
       AS code FROM part""",
)
def _(s: Survey) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.regexp_replace("p_brand", "Brand#", "")).otherwise(F.col("p_brand"))
    return s.table("part").select("p_partkey", text.try_cast("int").alias("code"))


@query(
    "b11_recode",
    """SELECT CASE continent_name WHEN 'AMERICA' THEN 'Americas' WHEN 'ASIA' THEN 'Asia, Oceania'
              WHEN 'MIDDLE EAST' THEN 'Asia, Oceania' WHEN 'EUROPE' THEN 'Europe, Eurasia'
              ELSE continent_name END AS continent, count(*) AS n FROM respp GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return tally(s.answers.withColumn("continent", C.recode("continent_name", _CONTINENTS)), "continent")


@query(
    "b12_biennium",
    """WITH y AS (SELECT CAST(1995 + o_orderkey % 40 AS INT) AS year FROM orders)
       SELECT CASE WHEN year BETWEEN 2002 AND 2023 THEN concat(CAST(year - year % 2 AS VARCHAR), '-',
              lpad(CAST((year - year % 2 + 1) % 100 AS VARCHAR), 2, '0')) END AS year2, count(*) AS n FROM y GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    years = s.table("orders").select((1995 + F.col("o_orderkey") % 40).cast("int").alias("year"))
    return tally(years.select(C.biennium("year").alias("year2")), "year2")


@query(
    "b13_five_year",
    f"""WITH y AS (SELECT CAST(2000 + o_orderkey % 25 AS INT) AS year, o_totalprice FROM orders)
        SELECT CASE WHEN year <= 2004 THEN '1998-2004' WHEN year <= 2009 THEN '2005-2009'
               WHEN year <= 2014 THEN '2010-2014' WHEN year <= 2021 THEN '2015-2021' END AS label,
               {r("avg(o_totalprice)", 4)} AS mean FROM y GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    years = s.table("orders").select((2000 + F.col("o_orderkey") % 25).cast("int").alias("year"), "o_totalprice")
    means = years.groupBy(C.five_year("year").alias("label")).agg(F.avg("o_totalprice").alias("mean"))
    return rounded(means, "mean", digits=4)


_STD_CASE = " ".join(
    f"WHEN x > {low} AND x <= {high} THEN '{label}'"
    for low, high, label in zip(C.STD_BREAKS, C.STD_BREAKS[1:], C.STD_LABELS, strict=False)
)


@query(
    "b14_cut",
    f"""WITH v AS (SELECT (l_quantity - 25.0E0) / 5.0E0 AS x FROM lineitem)
        SELECT CASE {_STD_CASE} END AS bin, count(*) AS n FROM v GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    scaled = (F.col("l_quantity") - 25.0) / 5.0
    return tally(s.table("lineitem").select(C.cut(scaled, C.STD_BREAKS, C.STD_LABELS).alias("bin")), "bin")


@query(
    "b15_direction",
    """SELECT CASE WHEN l_quantity - 25 > 0 THEN 'increase' WHEN l_quantity - 25 < 0 THEN 'decrease'
              ELSE 'stable' END AS change, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    return tally(s.table("lineitem").select(C.direction(F.col("l_quantity") - 25).alias("change")), "change")


@query(
    "b16_column_math",
    f"""SELECT mergekey, year2, {r("mean - 0.5E0")} AS diff, {r("mean / nullif(n - 20, 0)")} AS ratio,
               {r("abs(mean - 0.5E0)")} AS size, CAST(sign(mean - 0.5E0) AS DOUBLE) AS sgn,
               {r("CASE WHEN mean > 0 THEN ln(mean) END")} AS logged, {r("exp(mean)")} AS expd,
               round_even(exp(mean), 2) AS short FROM est_reg""",
)
def _(s: Survey) -> DataFrame:
    m = F.col("mean")
    out = s.est_reg.select(
        "mergekey",
        "year2",
        (m - 0.5).alias("diff"),
        F.try_divide(m, F.col("n") - 20).alias("ratio"),
        F.abs(m - 0.5).alias("size"),
        F.signum(m - 0.5).alias("sgn"),
        C.safe_ln(m).alias("logged"),
        F.exp(m).alias("expd"),
        F.bround(F.exp(m), 2).alias("short"),
    )
    return rounded(out, "diff", "ratio", "size", "logged", "expd")


@query(
    "c1_parameter_name",
    "SELECT regexp_replace(variable, '\\[.+\\]', '') AS parameter, count(*) AS n FROM draws GROUP BY 1",
)
def _(s: Survey) -> DataFrame:
    return tally(s.draw_values.select(C.param_name("variable").alias("parameter")), "parameter")


_VARIABLE_SQL = """SELECT CASE user_id % 4 WHEN 0 THEN concat('region_alpha[', CAST(user_id AS VARCHAR), ',', CAST(event_id % 7 AS VARCHAR), ']')
       WHEN 1 THEN concat('gamma[', CAST(user_id AS VARCHAR), ']') WHEN 2 THEN concat('other[', CAST(user_id AS VARCHAR), ']')
       ELSE 'lp__' END AS variable FROM events"""


@query(
    "c2_parameter_index",
    f"""WITH v AS ({_VARIABLE_SQL}),
        p AS (SELECT variable, regexp_replace(variable, '\\[.+\\]', '') AS parameter,
                     regexp_extract(variable, '\\[(.+)\\]$', 1) AS inside FROM v)
        SELECT parameter, CASE WHEN parameter IN ('region_alpha', 'gamma') THEN TRY_CAST(split_part(inside, ',', 1) AS INT) END AS i,
               CASE WHEN parameter IN ('region_alpha', 'gamma') THEN TRY_CAST(split_part(inside, ',', 2) AS INT) END AS j,
               count(*) AS n FROM p GROUP BY 1, 2, 3""",
)
def _(s: Survey) -> DataFrame:
    user, event = F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")
    kind = F.col("user_id") % 4
    variable = (
        F.when(kind == 0, F.concat(F.lit("region_alpha["), user, F.lit(","), event, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("gamma["), user, F.lit("]")))
        .when(kind == 2, F.concat(F.lit("other["), user, F.lit("]")))
        .otherwise("lp__")
    )
    parsed = s.table("events").select(variable.alias("variable")).select(
        C.param_name("variable").alias("parameter"),
        C.param_index("variable", 1).alias("i"),
        C.param_index("variable", 2).alias("j"),
    )
    return tally(parsed, "parameter", "i", "j")


_STEMS = ("concern_worry_", "human_caused_", "human_cause_", "human_", "concern_concern_", "happening_aware_")


def _replaced(expr: str, rules) -> str:
    for old, new in rules:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


@query(
    "c3_rename_items",
    f"""WITH t AS (SELECT concat(CASE p_size % 6 {" ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_STEMS))} END,
                                replace(p_name, ' ', '_')) AS item FROM part)
        SELECT {_replaced("item", C.ITEM_RULES)} AS question, count(*) AS n FROM t GROUP BY 1""",
)
def _(s: Survey) -> DataFrame:
    stem = F.element_at(F.array(*[F.lit(w) for w in _STEMS]), F.col("p_size") % 6 + 1)
    items = s.table("part").select(F.concat(stem, F.replace("p_name", F.lit(" "), F.lit("_"))).alias("item"))
    return tally(items.select(C.rename_items("item").alias("question")), "question")


@query(
    "c3_rename_item_columns",
    "SELECT l_orderkey, q_a_f AS worry_a, q_a_o AS attribution_a, q_n_f AS aware_n FROM resp_wide",
)
def _(s: Survey) -> DataFrame:
    named = s.wide.select(
        "l_orderkey",
        F.col("q_a_f").alias("concern_worry_a"),
        F.col("q_a_o").alias("human_caused_a"),
        F.col("q_n_f").alias("happening_aware_n"),
    )
    return clean.rename_item_cols(named)


@query(
    "c4_split_label",
    """SELECT p_partkey, split_part(label, ' ', 1) AS first, substr(label, length(split_part(label, ' ', 1)) + 2) AS rest,
              split_part(label, ' ', 2) AS second
       FROM (SELECT p_partkey, concat(p_name, ' ', p_type) AS label FROM part) t""",
)
def _(s: Survey) -> DataFrame:
    labelled = s.table("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    first, rest = C.split_label("label", " ", 2)
    second = C.split_label("label", " ", 2, merge=False)[1]
    return labelled.select("p_partkey", first.alias("first"), rest.alias("rest"), second.alias("second"))


@query(
    "c5_paste",
    """SELECT l_orderkey, concat(source2, '-', coalesce(CAST(q_a_f AS VARCHAR), 'NA'), '-', year2) AS label FROM resp_wide""",
)
def _(s: Survey) -> DataFrame:
    return s.wide.select("l_orderkey", C.paste("-", "source2", "q_a_f", "year2").alias("label"))


@query(
    "c6_prefix_and_drop_last",
    """SELECT substring(year2, 1, 4) AS year, left(question, length(question) - 2) AS stem, count(*) AS n
       FROM respp GROUP BY 1, 2""",
)
def _(s: Survey) -> DataFrame:
    return tally(
        s.answers.select(F.substring("year2", 1, 4).alias("year"), C.drop_last("question", 2).alias("stem")), "year", "stem"
    )
