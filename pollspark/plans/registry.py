"""Registry of queries over the test tables and their plain SQL counterparts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.plans.fixtures import Survey
from pollspark.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The survey-shaped views of FIXTURES.md, in dependency order.
VIEWS = {
    "resp": """
        SELECT l_orderkey, l_linenumber, r_name AS continent_name, n_name AS iso_3166,
               concat(n_name, ':', c_mktsegment) AS mergekey, o_orderpriority AS source2,
               o_orderstatus AS orderstatus, CAST(year(l_shipdate) + 7 AS INT) AS year,
               concat(l_returnflag, '_', l_linestatus) AS question,
               CAST(CASE WHEN l_returnflag = 'N' THEN least(ceil(l_quantity / 10), 3)
                    ELSE ceil(l_quantity / 10) END AS INT) AS option
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "respp": """
        SELECT *, concat(CAST(year - year % 2 AS VARCHAR), '-',
                         lpad(CAST((year - year % 2 + 1) % 100 AS VARCHAR), 2, '0')) AS year2,
               CAST((year - year % 2 - 2000) / 2 AS INT) AS year_int FROM resp""",
    "cells": """
        SELECT *, CAST(sum(yes) OVER (PARTITION BY mergekey, year_int, question) AS BIGINT) AS size FROM (
          SELECT continent_name, iso_3166, mergekey, year2, year_int, question, option, count(*) AS yes
          FROM respp WHERE orderstatus <> 'P' GROUP BY 1, 2, 3, 4, 5, 6, 7) t""",
    "cells_nat": """
        SELECT *, CAST(sum(yes) OVER (PARTITION BY iso_3166, year_int, question) AS BIGINT) AS size FROM (
          SELECT continent_name, iso_3166, year2, year_int, question, option, count(*) AS yes
          FROM respp WHERE orderstatus = 'P' GROUP BY 1, 2, 3, 4, 5, 6) t""",
    "weights": """
        SELECT iso_3166, mergekey, region_pop, region_pop * 1.0E0 / sum(region_pop) OVER (PARTITION BY iso_3166) AS wt
        FROM (SELECT n_name AS iso_3166, concat(n_name, ':', c_mktsegment) AS mergekey, count(*) AS region_pop
              FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) t""",
    "est_reg": """
        SELECT iso_3166, mergekey, year2, year_int,
               sum(yes * (option - 1) / CASE WHEN question LIKE 'N%' THEN 2.0E0 ELSE 4.0E0 END) / sum(yes) AS mean,
               CAST(sum(yes) AS BIGINT) AS n
        FROM cells GROUP BY 1, 2, 3, 4""",
    "est_nat": """
        SELECT e.iso_3166, year2, year_int, sum(mean * wt) / sum(wt) AS mean
        FROM est_reg e JOIN weights w ON e.mergekey = w.mergekey GROUP BY 1, 2, 3""",
    "spread_reg": """
        SELECT *, mean - 1.6448536269514722E0 * sd AS q5, mean + 1.6448536269514722E0 * sd AS q95 FROM (
          SELECT iso_3166, mergekey, year2, year_int, sum(yes * v) / sum(yes) AS mean,
                 sqrt(greatest(sum(yes * v * v) / sum(yes) - (sum(yes * v) / sum(yes)) * (sum(yes * v) / sum(yes)), 0.0E0) / sum(yes)) AS sd
          FROM (SELECT *, (option - 1) / CASE WHEN question LIKE 'N%' THEN 2.0E0 ELSE 4.0E0 END AS v FROM cells) t GROUP BY 1, 2, 3, 4) u""",
    "spread_nat": """
        SELECT *, mean - 1.6448536269514722E0 * sd AS q5, mean + 1.6448536269514722E0 * sd AS q95 FROM (
          SELECT s.iso_3166, year2, year_int, sum(mean * wt) / sum(wt) AS mean, sqrt(sum((wt * sd) * (wt * sd))) / sum(wt) AS sd
          FROM spread_reg s JOIN weights w ON s.mergekey = w.mergekey GROUP BY 1, 2, 3) u""",
    "draws": """
        SELECT variable, chain, row_number() OVER (PARTITION BY variable, chain ORDER BY event_id) AS iteration, value
        FROM (SELECT concat('region_alpha[', CAST(user_id % 3 + 1 AS VARCHAR), ',',
                            CAST(hour(ts) % 2 + 1 AS VARCHAR), ']') AS variable,
                     event_id % 4 + 1 AS chain, event_id, value FROM events) t""",
    "exposure": """
        SELECT n_name AS iso_3166, CASE WHEN n_nationkey % 10 = 3 THEN NULL ELSE avg(s_acctbal) END AS exposure
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
    "emissions": """
        SELECT n_name AS iso_3166, concat(n_name, ':', c_mktsegment) AS mergekey, sum(l_extendedprice) AS emissions
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE p_type = 'ECONOMY' GROUP BY 1, 2""",
    "resp_wide": """
        SELECT l_orderkey, iso_3166, mergekey, source2, min(year2) AS year2,
               max(CASE WHEN question = 'A_F' THEN code END) AS q_a_f,
               max(CASE WHEN question = 'A_O' THEN code END) AS q_a_o,
               max(CASE WHEN question = 'N_F' THEN code END) AS q_n_f,
               max(CASE WHEN question = 'N_O' THEN code END) AS q_n_o,
               max(CASE WHEN question = 'R_F' THEN code END) AS q_r_f,
               max(CASE WHEN question = 'R_O' THEN code END) AS q_r_o
        FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN -1 ELSE option END AS code FROM respp) t GROUP BY 1, 2, 3, 4""",
    "resp_long": """
        SELECT l_orderkey, iso_3166, mergekey, source2, year2, unnest(['q_a_f', 'q_a_o', 'q_n_f', 'q_n_o', 'q_r_f', 'q_r_o'])
               AS question, unnest([q_a_f, q_a_o, q_n_f, q_n_o, q_r_f, q_r_o]) AS answer FROM resp_wide""",
    "item_gamma": """
        SELECT question, avg(option) / 2.5E0 AS gamma_raw, max(option) - 1 AS kmin1 FROM cells GROUP BY 1""",
    "item_beta": """
        SELECT c.question, k, k + avg(CASE WHEN option <= k THEN 1.0E0 ELSE 0.0E0 END) AS beta_raw
        FROM cells c CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ks GROUP BY 1, 2""",
    "drifting": """
        SELECT iso_3166, mergekey, year2, year_int, mean,
               CASE WHEN (year2 = '2008-09' AND length(mergekey) % 6 IN (0, 2))
                      OR (year2 = '2006-07' AND length(mergekey) % 6 = 0) THEN 0 ELSE n END AS obs FROM est_reg""",
    "continents": """
        SELECT n_name AS iso_3166, r_name AS continent_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "places": """
        SELECT c_custkey, r_name AS continent_name, n_name AS iso_3166, concat(n_name, ':', c_mktsegment) AS mergekey
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "shapes": """
        SELECT DISTINCT iso_3166, mergekey, continent_name FROM places
        UNION ALL SELECT replace(iso_3166, 'NATION', 'LAND'), concat(replace(iso_3166, 'NATION', 'LAND'), ':NONE'), NULL
        FROM continents WHERE iso_3166 IN ('NATION_0', 'NATION_1')""",
    "outside": """
        SELECT iso_3166, mergekey, CAST(year(o_orderdate) + 7 AS INT) AS year, o_totalprice AS concern
        FROM orders JOIN places ON o_custkey = c_custkey""",
    "embedded": """
        SELECT vec_id, label AS source, """
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, 65))
    + " FROM embeddings",
    "region_means": """
        SELECT iso_3166, mergekey, year2, question, sum(yes * option) * 1.0E0 / sum(yes) AS avg_resp
        FROM cells GROUP BY 1, 2, 3, 4""",
    "region_codes": """
        SELECT mergekey, iso_3166, CAST(dense_rank() OVER (ORDER BY mergekey) AS INT) AS regioncode_int
        FROM (SELECT DISTINCT mergekey, iso_3166 FROM cells) t""",
    "country_codes": """
        SELECT iso_3166, CAST(dense_rank() OVER (ORDER BY iso_3166) AS INT) AS iso_3166_int
        FROM (SELECT iso_3166 FROM cells UNION SELECT iso_3166 FROM cells_nat) t""",
    "question_codes": """
        SELECT question, CAST(dense_rank() OVER (ORDER BY question) AS INT) AS question_int
        FROM (SELECT question FROM cells UNION SELECT question FROM cells_nat) t""",
    "disc": """
        SELECT concat('q_', lower(question)) AS question, gamma_raw AS discrimination FROM item_gamma""",
    "nat_scaled": """
        SELECT iso_3166, year2, mean, (mean - avg(mean) OVER ()) / stddev_samp(mean) OVER () AS mean_std,
               (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) AS mean_scl FROM est_nat""",
    "reg_scaled": """
        SELECT iso_3166, mergekey, year2, mean, (mean - avg(mean) OVER ()) / stddev_samp(mean) OVER () AS mean_std,
               (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) AS mean_scl FROM est_reg""",
}


def _needed(sql: str) -> list[str]:
    found: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "''", queue.pop())))
        fresh = [v for v in VIEWS if v in words and v not in found]
        found.update(fresh)
        queue.extend(VIEWS[v] for v in fresh)
    # A view is listed after the ones it reads.
    placed: list[str] = []

    def place(name: str) -> None:
        for other in VIEWS:
            if other != name and other in found and re.search(rf"\b{other}\b", re.sub(r"'[^']*'", "''", VIEWS[name])):
                place(other)
        if name not in placed:
            placed.append(name)

    for name in VIEWS:
        if name in found:
            place(name)
    return placed


def with_views(sql: str) -> str:
    """Put the views that ``sql`` reads in front of it as common table expressions."""
    own, body = re.match(r"\s*(?:WITH\s+)?(.*)", sql, re.S), sql.strip()
    starts_with = body.startswith("WITH ")
    rest = own.group(1) if starts_with else body
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql)]
    if starts_with:
        return "WITH " + ",\n".join([*ctes, rest])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + rest


def query(name: str, sql: str | None = None):
    """Register a function of a ``Survey`` under ``name``, with its SQL if there is one."""

    def register(fn: Callable[[Survey], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Survey(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def r(expr: str, digits: int = 6) -> str:
    """Rounded double in SQL; adding 0 turns a negative zero into zero."""
    return f"(round({expr}, {digits}) + 0.0E0)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round computed doubles so that engines that add in another order agree."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for queries that write and read back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
