"""Physical plans: no pairing of rows, no row-at-a-time Python, no single-task windows."""

import re

import pytest

from pollspark.plans.catalog import QUERIES

# Steps that need numpy: Newton steps, small eigenvalue problems.
PYTHON = {"i13_posterior_mode", "j13_parallel_analysis", "j14_permuted_null", "j14_number_of_factors"}
# Windows without partition over the handful of rows of an eigenvalue table. Others may
# only add up ``__total``, which has one row per partition of the data.
TINY = {"j14_number_of_factors", "j14_factor_rules"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan, bad
    if name not in PYTHON:
        assert "Python" not in plan and "InPandas" not in plan
    if name not in TINY:
        # A window prints its partition columns in the first brackets after the functions.
        for line in plan.splitlines():
            if re.search(r"Window \[", line) and "[sum(__total" not in line:
                assert not re.search(r"windowspecdefinition\((specifiedwindowframe|[^,]* (ASC|DESC) NULLS)", line), line[:200]


def test_pushdown_and_pruning(spark):
    plan = plan_of(QUERIES["i1_ordinal_counts"](spark, "/root/testdata/sf0.001"))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    lineitem = next(line for line in scans if "lineitem.parquet" in line)
    assert "l_extendedprice" not in lineitem and "l_tax" not in lineitem
    orders = next(line for line in scans if "orders.parquet" in line)
    assert "o_totalprice" not in orders and "Not(EqualTo(o_orderstatus,P))" in orders


def test_variant_is_a_partition_filter(spark, tmp_path):
    from pyspark.sql import functions as F

    from pollspark.sources import tables as T

    for name in ("a", "b"):
        T.write_table(spark.range(3).withColumn("x", F.lit(1)), str(tmp_path), "t", name)
    plan = plan_of(T.load_table(spark, str(tmp_path), "t", "a"))
    assert re.search(r"PartitionFilters: \[[^\]]*variant", plan)


def test_top_rows_per_group_are_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["g7_extremes_by_group"](spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cells_are_counted_before_the_shuffle(spark):
    plan = plan_of(QUERIES["i1_ordinal_counts"](spark, "/root/testdata/sf0.001"))
    assert "partial_count" in plan


def test_line_items_are_read_and_shuffled_once(spark):
    """Without broadcasting: one scan, one shuffle of rows for the join, and counts made before the next shuffle."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["i1_ordinal_counts"](spark, "/root/testdata/sf0.001"))
        both = {name: plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")) for name in ("d2_full_join", "e1_union_all", "f7_country_obs", "f9_total_responses")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("lineitem.parquet") == 1
    assert len(re.findall(r"hashpartitioning\(l_orderkey", plan)) == 1
    assert not re.search(r"hashpartitioning\(o_custkey[^\n]*\n[^\n]*l_orderkey", plan)
    # Both levels come from one stored table of cells.
    assert all("lineitem" not in p for p in both.values())
