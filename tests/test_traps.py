"""Small tables, one per place where engines or tools commonly differ."""

import pytest
from pyspark.sql import functions as F

from pollspark.functions import columns as C
from pollspark.operators import aggregate as A
from pollspark.operators import clean, dimension, periods, ranking, regress
from pollspark.operators import relate as D
from pollspark.operators import packed as P
from pollspark.operators import scores as S
from pollspark.operators import shape as G
from pollspark.operators.cells import merged_cells, ordinal_counts, store_cells
from pollspark.plans import reports as K
from pollspark.sources import tables as T


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_missing_keys_match(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, l int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, r int")
    assert sorted(rows(D.left_join(left, right, "k"), "l", "r")) == [(1, 10), (2, 20)]
    assert sorted(rows(D.left_join(left, right, "k", null_safe=False), "l", "r"), key=str) == [(1, 10), (2, None)]
    assert sorted(rows(D.full_join(left, right, ["k"]), "l", "r")) == [(1, 10), (2, 20)]


def test_join_on_different_names_and_many_keys(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 6.0)], "code string, t int, w double")
    out = D.left_join(left, right, [("k", "code"), "t"])
    assert out.columns == ["k", "t", "v", "w"]
    assert sorted(rows(out, "v", "w")) == [("x", 5.0), ("y", None)]
    full = D.full_join(left.withColumnRenamed("k", "code"), right, ["code", "t"])
    assert sorted(rows(full, "code", "t", "v", "w")) == [("a", 1, "x", 5.0), ("a", 2, "y", None), ("b", 1, None, 6.0)]


def test_no_nan_for_empty_mean_or_single_value(spark):
    df = spark.createDataFrame([("g", None), ("h", 2.0)], "k string, x double")
    assert dict(rows(A.mean_answers(df, ["k"], ["x"]), "k", "avg_resp")) == {"g": None, "h": 2.0}
    assert dict(rows(G.standardise(df, "x", ["k"]), "k", "x_std")) == {"g": None, "h": None}


def test_csv_na_is_missing_but_not_other_text(spark, tmp_path):
    df = spark.createDataFrame([("NAM", None), ("TD", 0.5)], "iso string, v double")
    T.write_csv(df, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    assert "NAM,NA" in text
    assert sorted(rows(T.read_csv(spark, str(tmp_path / "x"), "iso string, v double"))) == [("NAM", None), ("TD", 0.5)]
    spark.createDataFrame([("NA", 1.0)], "iso string, v double").write.mode("overwrite").csv(str(tmp_path / "y"))
    back = T.read_csv(spark, str(tmp_path / "y"), "iso string, v double", header=False)
    assert rows(back) == [(None, 1.0)]
    (tmp_path / "z.csv").write_text("a,,2\n,b,\n")
    empty = T.read_csv(spark, str(tmp_path / "z.csv"), "x string, y string, n int", header=False)
    assert rows(empty) == [("a", None, 2), (None, "b", None)]


def test_write_table_replaces_one_variant_only(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1,)], "x int")
    for name, value in (("a", 1), ("b", 2), ("a", 3)):
        T.write_table(df.withColumn("x", F.lit(value)), root, "t", name)
    assert rows(T.load_table(spark, root, "t", "a")) == [(3,)]
    assert rows(T.load_table(spark, root, "t", "b")) == [(2,)]


def test_variant_name():
    assert T.variant("m", "2yr", "q") == "m_2yr_q"
    assert T.variant("m", "2yr", "q", "oecd") == "m_2yr_q_oecd"


def test_bad_number_is_missing(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,)], "t string")
    assert rows(df.select(F.col("t").try_cast("int"))) == [(3,), (None,), (None,)]


def test_paste_writes_missing_as_text(spark):
    df = spark.createDataFrame([("a", None, 1)], "x string, y string, z int")
    assert rows(df.select(C.paste("-", "x", "y", "z"))) == [("a-NA-1",)]


def test_cut_is_right_closed_and_missing_outside(spark):
    df = spark.createDataFrame([(x,) for x in (-3.0, -2.0, 4.0, 4.1, 0.5, None)], "x double")
    assert [r[0] for r in rows(df.select(C.cut("x", C.STD_BREAKS, C.STD_LABELS)))] == [None, "-2", "2+", None, "0", None]
    unit = spark.createDataFrame([(0.0,), (0.1,), (1.0,)], "x double")
    assert [r[0] for r in rows(unit.select(C.cut("x", C.SCL_BREAKS, C.SCL_LABELS)))] == ["0-0.1", "0-0.1", "0.9-1"]


def test_biennium_edges(spark):
    df = spark.createDataFrame([(y,) for y in (2001, 2002, 2003, 2009, 2022, 2023, 2024, None)], "y int")
    got = [r[0] for r in rows(df.select(C.biennium("y")))]
    assert got == [None, "2002-03", "2002-03", "2008-09", "2022-23", "2022-23", None, None]


def test_five_year_edges(spark):
    df = spark.createDataFrame([(y,) for y in (1998, 2004, 2005, 2014, 2021, 2022)], "y int")
    got = [r[0] for r in rows(df.select(C.five_year("y")))]
    assert got == ["1998-2004", "1998-2004", "2005-2009", "2010-2014", "2015-2021", None]


def test_correlation_modes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "x double, y double")
    assert df.agg(A.correlation("x", "y")).first()[0] == pytest.approx(1.0)
    assert df.agg(A.correlation("x", "y", "everything")).first()[0] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(A.correlation("x", "y")).first()[0] is None


def test_country_flags_join_on_the_flag(spark):
    cells = spark.createDataFrame([("A", 1, 0), ("B", 1, 3)], "c string, t int, size long")
    nat = spark.createDataFrame([("A", 1, 5), ("B", 1, 2)], "c string, t int, size long")
    assert sorted(rows(A.country_obs(cells, nat, "c", "t"))) == [("A", 1, 0), ("A", 1, 1), ("B", 1, 1)]


def test_cutpoints_join_by_code_not_position(spark):
    summary = spark.createDataFrame(
        [("beta[1,1]", 0.1), ("beta[1,2]", 0.2), ("beta[7,1]", 0.3), ("beta[7,2]", 0.4), ("beta[7,3]", 0.5)],
        "variable string, mean double",
    )
    cells = spark.createDataFrame([(1, 2), (1, 1), (7, 3)], "question_int int, option int")
    got = rows(S.decode_cutpoints(summary, cells), "question_int", "option", "mean")
    assert sorted(got) == [(1, 1, 0.1), (7, 1, 0.3), (7, 2, 0.4)]
    runs = spark.createDataFrame([("beta[1]", 0.1), ("beta[2]", 0.3), ("beta[3]", 0.4)], "variable string, mean double")
    got = rows(S.decode_cutpoints(runs, cells, sequence=True), "question_int", "option", "mean")
    assert sorted(got) == [(1, 1, 0.1), (7, 1, 0.3), (7, 2, 0.4)]


def test_region_observations_count_questions(spark):
    cells = spark.createDataFrame(
        [("r", 1, "q1", 1, 2, 5), ("r", 1, "q1", 2, 3, 5), ("r", 1, "q2", 1, 4, 4)],
        "u string, t int, question string, option int, yes long, size long",
    )
    assert rows(A.region_obs(cells, "u", "t")) == [("r", 1, 2)]
    assert rows(A.samples(cells, "u")) == [("r", 14)]


def test_final_period_dropped_after_the_choice(spark):
    df = spark.createDataFrame(
        [("a", "2002-03", 1.0, 3), ("a", "2008-09", 2.0, 1), ("b", "2004-05", 3.0, 2), ("b", "2008-09", 4.0, 0)],
        "mergekey string, year2 string, mean double, obs int",
    )
    assert rows(G.last_observed(df, "mergekey", "year2", "2008-09")) == [("b", "2004-05", 3.0, 2)]


def test_drift_signs(spark):
    # One region per case; the nation goes up by 0.2.
    ends = {"up_less": 0.1, "up_same": 0.25, "over": 0.35, "away": -0.05, "flat": 0.0}
    reg = [(k, "N", "2002-03", 0.0, 1) for k in ends] + [(k, "N", "2022-23", v, 0) for k, v in ends.items()]
    est = spark.createDataFrame(reg, "mergekey string, iso_3166 string, year2 string, mean double, obs int")
    nat = spark.createDataFrame([("N", "2002-03", 0.0), ("N", "2022-23", 0.2)], "iso_3166 string, year2 string, mean double")
    flags = dict(rows(periods.flag_drift(est, nat, "2022-23"), "mergekey", "toobig"))
    assert flags == {"up_less": 0, "up_same": 0, "over": 1, "away": 1, "flat": 1}
    lines = periods.interpolate(periods.flag_drift(est, nat, "2022-23"), end=2022)
    over = sorted(rows(lines.where("mergekey = 'over'"), "year2", "mean_interp"))
    assert [y for y, _ in over] == [f"{y}-{(y + 1) % 100:02d}" for y in range(2002, 2024, 2)]
    assert over[0][1] == 0.0 and over[-1][1] == pytest.approx(0.2) and over[5][1] == pytest.approx(0.1)
    back = periods.apply_interpolation(est, lines)
    got = {(k, y): (m, i) for k, y, m, i in rows(back, "mergekey", "year2", "mean", "interpolated")}
    assert got[("over", "2002-03")] == (0.0, 0) and got[("over", "2022-23")][1] == 1
    assert got[("up_less", "2022-23")] == (0.1, 0)


def test_correlation_matrix_can_skip_the_first_item(spark):
    long = spark.createDataFrame(
        [(u, q, float(u * k + (u % 2))) for u in range(5) for k, q in enumerate("abc", 1)], "u int, q string, v double"
    )
    assert dimension.corr_matrix(long, "u", "q", "v", "abc").count() == 9
    assert dimension.corr_matrix(long, "u", "q", "v", "abc", skip_first=True).count() == 4
    many = [f"i{k:02}" for k in range(80)]
    plans = [
        dimension.corr_matrix(long, "u", "q", "v", names)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
        for names in ("abc", many)
    ]
    assert plans[0] == plans[1] < 8
    assert dimension.corr_matrix(long, "u", "q", "v", many).where("corr IS NULL").count() == 6400


def test_half_even_rounding(spark):
    assert one(spark, F.bround(F.lit(2.5))) == 2
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "k int, x double")
    halves = dict(rows(G.half_groups(df, [F.col("x"), F.col("k")]), "k", "half"))
    assert halves == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}


def test_ends_break_ties_by_key_and_both_lists_are_distinct(spark):
    df = spark.createDataFrame([(k, "g", 1.0) for k in "cab"], "mergekey string, g string, mean double")
    ends = rows(G.extremes(df, "mean", 2, "mergekey"), "mergekey", "side")
    assert sorted(ends) == [("a", "bottom"), ("a", "top"), ("b", "bottom"), ("b", "top")]
    twice = df.unionByName(df)
    labelled = K.interval_table(twice, 2, ["mergekey", "g"], "mergekey", ["g"])
    assert labelled.count() == 4


def test_log_of_zero_is_missing(spark):
    assert one(spark, C.safe_ln(F.lit(0.0))) is None
    em = spark.createDataFrame([("x", "C", 0.0), ("y", "C", 2.0), ("z", "C", 4.0)], "code string, country string, kilotons double")
    xw = spark.createDataFrame([("x", "r1"), ("y", "r2"), ("z", "r3")], "code string, mergekey string")
    pop = spark.createDataFrame([("r1", 10), ("r2", 10), ("r3", 10)], "mergekey string, region_pop int")
    out = regress.emissions_per_capita(em, xw, pop)
    got = dict(rows(out, "mergekey", "percap_ln_std"))
    assert got["r1"] is None and got["r2"] == pytest.approx(-(0.5**0.5))
    assert dict(rows(out, "mergekey", "percap_bin")) == {"r1": "0-1", "r2": None, "r3": None}


def test_name_clash_gets_suffixes(spark):
    a = spark.createDataFrame([("k", 1, 2)], "k string, x int, y int")
    b = spark.createDataFrame([("k", 5)], "k string, x int")
    assert D.inner_join(a, b, ["k"]).columns == ["k", "x.x", "y", "x.y"]
    assert D.inner_join(a, b.withColumn("x", F.lit(1))).columns == ["k", "x", "y"]


def test_parameter_names(spark):
    df = spark.createDataFrame([("region_alpha[3,7]",), ("gamma[12]",), ("lp__",), ("mu[4]",)], "v string")
    got = rows(df.select(C.param_name("v"), C.param_index("v", 1), C.param_index("v", 2)))
    assert got == [("region_alpha", 3, 7), ("gamma", 12, None), ("lp__", None, None), ("mu", None, None)]


def test_item_renames_run_in_order(spark):
    df = spark.createDataFrame([("concern_worry_x",), ("human_caused_y",), ("human_z",)], "q string")
    assert [r[0] for r in rows(df.select(C.rename_items("q")))] == ["worry_x", "attribution_y", "attribution_z"]
    cols = spark.createDataFrame([(1, 2)], "happening_aware_a int, concern_b int")
    assert clean.rename_item_cols(cols).columns == ["aware_a", "worry_b"]


def test_split_label_keeps_or_drops_the_rest(spark):
    df = spark.createDataFrame([("worry_serious_pew",)], "q string")
    assert rows(df.select(*C.split_label("q", "_", 2))) == [("worry", "serious_pew")]
    assert rows(df.select(*C.split_label("q", "_", 2, merge=False))) == [("worry", "serious")]
    dotted = spark.createDataFrame([("US.CA",)], "q string")
    assert rows(dotted.select(*C.split_label("q", ".", 2))) == [("US", "CA")]


def test_negative_codes_and_any_answer(spark):
    df = spark.createDataFrame([(1, -1, 2), (2, None, None)], "id int, a int, b int")
    assert rows(clean.null_negative(df, ["a", "b"])) == [(1, None, 2), (2, None, None)]
    assert rows(clean.any_answered(df, ["a", "b"]), "id") == [(1,)]
    assert rows(clean.complete_cases(df), "id") == [(1,)]
    assert clean.cols_like(df, "b", "a") == ["b", "a"]


def test_fan_out_limit(spark):
    left = spark.createDataFrame([("a",)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    D.check_fan_out(left, right, "k", 2)
    with pytest.raises(ValueError):
        D.check_fan_out(left, right, "k", 1)


def test_map_table_repeats_empty_shapes(spark):
    shapes = spark.createDataFrame([("a", "EUROPE"), ("b", None)], "mergekey string, continent_name string")
    est = spark.createDataFrame([("a", "2010-11", 1.0)], "mergekey string, year2 string, mean_std double")
    table = K.map_table(shapes, est, "mergekey", ["2010-11", "2022-23"])
    got = sorted(rows(table, "mergekey", "year2", "mean_std"), key=str)
    assert got == [("a", "2010-11", 1.0), ("b", "2010-11", None), ("b", "2022-23", None)]
    assert rows(K.region_window(table, ["ASIA"], "2022-23"), "mergekey", "continent_name") == [("b", "Missing")]


def test_five_year_comparison(spark):
    est = spark.createDataFrame(
        [("US-CA", "US", "2005-2009", 1.0, 0.5), ("US-TX", "US", "2005-2009", 2.0, 0.7)],
        "mergekey string, iso_3166 string, year2 string, mean double, mean_scl double",
    )
    other = spark.createDataFrame([("CA", 2005, 1.0), ("CA", 2009, 3.0), ("TX", 2006, 5.0)], "abb string, year int, concern double")
    got = sorted(rows(K.compare_subnational(est, other, "US", collapse="5yr"), "abb", "outside", "corr"))
    assert got == [("CA", 2.0, 1.0), ("TX", 5.0, 1.0)]


def test_respondents(spark):
    df = spark.createDataFrame([(1, 5, None), (1, None, None), (None, 3, 4)], "constructed int, a int, b int")
    got = sorted(rows(K.respondent_counts(df, ["a", "b"], "constructed"), "constructed", "respondents", "answered"), key=str)
    assert got == [("1", 2, 1), (None, 1, 1)]


def test_region_in_two_countries_is_refused(spark):
    from pollspark.operators import cells

    df = spark.createDataFrame([("r", "A"), ("r", "B")], "mergekey string, iso string")
    with pytest.raises(ValueError):
        cells.region_country(df, "mergekey", "iso")
    bad = spark.createDataFrame([("A", 0.5), ("A", 0.4)], "iso string, wt double")
    with pytest.raises(ValueError):
        cells.check_weights(bad, "iso")


def test_missing_keys_match_in_every_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 9), ("a", 8)], "k string, y int")
    assert {tuple(r) for r in D.inner_join(left, right, ["k"]).select("k", "x", "y").collect()} == {(None, 1, 9), ("a", 2, 8)}
    assert {tuple(r) for r in D.natural_left_join(left, right).select("k", "x", "y").collect()} == {(None, 1, 9), ("a", 2, 8), ("b", 3, None)}
    assert {r.x for r in D.semi_join(left, right, "k").collect()} == {1, 2}
    assert {r.x for r in D.anti_join(left, right, "k").collect()} == {3}
    assert D.inner_join(left, right, ["k"], null_safe=False).count() == 1


def test_unscored_country_is_patched_after_scaling(spark):
    stats = spark.createDataFrame(
        [("s", c, "2002-03", "q", 10, v) for c, v in (("NG", 1.0), ("GH", 2.0), ("AO", 9.0))],
        "source2 string, iso_3166 string, year2 string, question string, size long, avg_resp double",
    )
    est = spark.createDataFrame([(c, "2002-03", m, "Africa") for c, m in (("NG", 0.1), ("GH", 0.3))], "iso_3166 string, year2 string, mean double, continent_name string")
    disc = spark.createDataFrame([("q", 1.0)], "question string, discrimination double")
    points = K.with_correlations(K.validation_table(stats, est, disc, disc.select("question")))
    scaled = {r.iso_3166: r.prop_scl for r in points.collect()}
    assert scaled["NG"] == pytest.approx(-0.5**0.5) and scaled["GH"] == pytest.approx(0.5**0.5)
    kept = K.corr_points(points, spark.createDataFrame([("q-s",)], "qsource string"))
    assert {r.iso_3166 for r in kept.collect()} == {"NG", "GH"}
    published = {r.iso_3166: r.continent_name for r in K.with_unscored_continents(points).collect()}
    assert published["AO"] == "Africa"


def test_interpolation_without_room(spark):
    rows = [("r1", "2008-09"), ("r2", "2010-11"), ("r3", "2004-05")]
    flagged = spark.createDataFrame([(k, 0.5, 0.2, y, 1) for k, y in rows], "mergekey string, reg_mean double, delta_nat double, year2 string, toobig int")
    lines = periods.interpolate(flagged, end=2008)
    assert {(r.mergekey, r.year2, r.later) for r in lines.collect()} == {("r3", "2004-05", False), ("r3", "2006-07", True), ("r3", "2008-09", True)}
    est = spark.createDataFrame([("r3", y, 0.4) for y in ("2004-05", "2006-07", "2008-09")], "mergekey string, year2 string, mean double")
    done = {r.year2: (r.interpolated, round(r.mean, 9)) for r in periods.apply_interpolation(est, lines).collect()}
    assert done == {"2004-05": (0, 0.4), "2006-07": (1, 0.6), "2008-09": (1, 0.7)}


def test_quantiles_with_nan_and_bad_brackets(spark, monkeypatch):
    rows = [(k, float(v)) for k in ("a", "b") for v in range(1, 1001)] + [("a", float("nan"))] * 10 + [("c", float("nan")), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    expected = {"a": (500.5, 950.05), "b": (500.5, 950.05), "c": (None, None)}
    for accuracy, limit in ((10_000, 10**6), (20, 10**6), (20, 5)):
        got = {r.k: (r.q50, r.q95) for r in ranking.quantiles(df, "v", [0.5, 0.95], ["k"], accuracy=accuracy, bracket_rows=limit).collect()}
        assert got["c"] == expected["c"] and all(got[k] == pytest.approx(expected[k]) for k in "ab")
    plain = F.percentile_approx
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda c, edges, acc: F.transform(plain(c, edges, acc), lambda e: e + 300))
    got = {r.k: (r.q50, r.q95) for r in ranking.quantiles(df, "v", [0.5, 0.95], ["k"], accuracy=20).collect()}
    assert all(got[k] == pytest.approx(expected[k]) for k in "ab")
    assert ranking.quantiles(df.where("v < 0"), "v", [0.5]).collect()[0].q50 is None


def test_pivot_refuses_unlisted_names(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 3.0)], "k string, n string, v double")
    with pytest.raises(ValueError):
        G.pivot_wider(df, ["k"], "n", "v", ["x"])
    assert [tuple(r) for r in G.pivot_wider(df, ["k"], "n", "v", ["x", "y"]).collect()] == [("a", 2.0, 3.0)]


def test_scores_that_differ_by_rounding_only_have_no_standard_score(spark):
    """0.3 and 0.1 + 0.2 are one value to every operator that standardises."""
    df = spark.createDataFrame([(i, 0.3 if i % 2 else 0.1 + 0.2) for i in range(10)], "i int, mean double")
    got = K.scale_estimates(df).collect()
    assert all(r.mean_std is None and r.mean_std_bin is None for r in got)
    scaled, kept = dimension.screen_items(df.withColumn("other", F.col("i").cast("double")), ["mean", "other"])
    assert all(r["mean"] is None for r in scaled.collect())


def test_partial_r2_does_not_depend_on_units(spark):
    rows = [(f"g{i % 5}", float((i * 7) % 13), float((i * 5) % 11 + i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    plain = regress.partial_r2(df, "y", "x", "g").first().partial_r2
    for scale in (1e-8, 1e8, 1e-150):
        other = regress.partial_r2(df.withColumn("x", F.col("x") * scale), "y", "x", "g").first().partial_r2
        assert other == pytest.approx(plain, rel=1e-9)
    level = df.withColumn("x", F.lit(0.1) + F.lit(0.2) + (F.col("x") > 100).cast("int"))
    assert regress.partial_r2(level, "y", "x", "g").first().partial_r2 is None


def test_pivot_refuses_a_missing_name(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0)], "id int, name string, value double")
    with pytest.raises(ValueError):
        G.pivot_wider(df, ["id"], "name", "value", ["a", "b"])


def test_respondents_are_counted_in_one_scan(spark):
    df = spark.createDataFrame([(1, None, 2), (1, None, None), (None, 3, None)], "code int, a int, b int")
    out = K.respondent_counts(df, ["a", "b"], "code")
    assert {tuple(r) for r in out.collect()} == {("1", 2, 1), (None, 1, 1)}
    total = K.full_sample(df, ["a", "b"], df.limit(1)).first()
    assert tuple(total) == (2, 1, 3)


def test_packed_draws_equal_single_ones(spark):
    rows = [(f"r{u}", t, d, float(u * 7 + t * 3 + d) ** 0.5) for u in range(6) for t in range(2) for d in range(11) if (u, d) != (2, 4) and u + d != 13]
    rows += [(f"r{u}", t, 4, None) for u in (0,) for t in range(2)]
    draws = spark.createDataFrame([(*r[:3], None if r[0] == "r0" and r[2] == 4 else r[3]) for r in rows], "mergekey string, year_int int, draw int, region_effect double")
    regions = spark.createDataFrame([(f"r{u}", "ab"[u % 2]) for u in range(6)], "mergekey string, iso_3166 string")
    weights = spark.createDataFrame([(f"r{u}", 0.1 + u / 10) for u in range(6)], "mergekey string, wt double")
    walk = spark.createDataFrame([(c, t, d, d / 10) for c in "ab" for t in range(2) for d in range(11)], "iso_3166 string, year_int int, draw int, country_alpha double")
    plain = S.region_scores(walk, draws, regions, ("year_int", "draw"))
    effects = P.pack_draws(draws, ["mergekey", "year_int"], "draw", "region_effect", 4)
    assert {len(r.region_effect) for r in effects.collect()} == {3, 4}
    scores = P.packed_region_scores(P.pack_draws(walk, ["iso_3166", "year_int"], "draw", "country_alpha", 4), effects, regions)
    for renormalise in (False, True):
        want = S.poststratify(plain.where("region_alpha IS NOT NULL"), weights, "region_alpha", ("year_int", "draw"), renormalise)
        got = P.unpack_draws(P.packed_poststratify(scores, weights, "region_alpha", renormalise=renormalise), "country_poststrat", block=4)
        a = {tuple(r)[:3]: r.country_poststrat for r in want.collect()}
        b = {tuple(r)[:3]: r.country_poststrat for r in got.collect()}
        assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, rel=1e-12) for k, v in a.items())


def test_waves_in_any_order_and_twice(spark, tmp_path):
    answers = spark.createDataFrame(
        [(f"s{i % 3}", f"200{i % 2}-0{i % 2 + 1}", f"g{i % 4}", f"q{i % 5}", i % 2 + 1) for i in range(300)] + [(None, "2002-03", None, "q1", 1)],
        "source string, year2 string, geo string, question string, option int",
    )
    want = sorted(map(tuple, ordinal_counts(answers, ["geo"], ["year2"]).collect()), key=str)
    one, two = answers.where("source = 's1'"), answers.where("source IS DISTINCT FROM 's1'")
    for i, waves in enumerate(([one, two], [two, one], [one, two, one, one])):
        folder = str(tmp_path / str(i))
        for wave in waves:
            store_cells(wave, folder, ["geo"], ["year2"], "source")
        got = merged_cells(spark, folder, ["geo"], ["year2"])
        assert got.columns == ordinal_counts(answers, ["geo"], ["year2"]).columns
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_bitmaps_are_exact_and_merge(spark, monkeypatch):
    rows = [("a" if i % 3 else "b", i * 977 % 100_003, i % 7 if i % 5 else None) for i in range(5000)] + [("c", None, None), ("a", 0, 0), ("a", 32767, 1), ("a", 32768, 1)]
    df = spark.createDataFrame(rows, "k string, x int, y int")
    want = {r.k: (r.x, r.y) for r in df.groupBy("k").agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).collect()}
    sets = A.bitmaps(df, ["k"], ["x", "y"])
    assert sets._jdf.queryExecution().executedPlan().toString().count("Expand") == 0
    assert {r.k: (r.x, r.y) for r in A.bitmap_distinct(sets, ["k"], ["x", "y"]).collect()} == want
    halves = A.bitmaps(df.where("x % 2 = 0"), ["k"], ["x", "y"]).unionByName(A.bitmaps(df.where("x % 2 <> 0 OR x IS NULL"), ["k"], ["x", "y"]))
    assert {r.k: (r.x, r.y) for r in A.bitmap_distinct(halves, ["k"], ["x", "y"]).collect()} == want
    monkeypatch.setattr(A, "BESIDE", 1)  # more codes than fit side by side; a group without codes has no row there
    many = {r.k: (r.x, r.y) for r in A.bitmap_distinct(A.bitmaps(df, ["k"], ["x", "y"]), ["k"], ["x", "y"]).collect()}
    assert many == {k: v for k, v in want.items() if k != "c"}
