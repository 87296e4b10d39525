"""Mixing and Merkle fingerprints: SQL over the tables, small cases, plans without Python."""

import hashlib
import math
import re

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from pollspark.llm import merkle, mixing
from pollspark.llm.merkle import LEAF, differing, edited, fingerprints, likeness
from pollspark.llm.mixing import mix, weights


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "query, sql",
    [(mixing.op1_temperature_mixing, mixing.ORACLE_SQL), (merkle.op10_merkle_fingerprints, merkle.ORACLE_SQL)],
    ids=["op1", "op10"],
)
def test_same_rows_as_sql(spark, small, query, sql):
    df = query(spark, small)
    assert differences(df, connect(small), sql) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


ROWS = [(i, "hot" if i % 3 else f"s{i % 4}", (i * 37) % 50 + 1) for i in range(3000)] + [(9000, None, 7), (9000, None, 7), (9001, "void", 0)]


def test_passes_meet_the_budget(spark):
    rows = spark.createDataFrame(ROWS, "k long, source string, n int")
    plan = {r["__source"]: r for r in weights(rows, "source", "n").collect()}
    assert sum(r.weight for r in plan.values()) == pytest.approx(1)
    assert max(r.passes for r in plan.values()) == pytest.approx(2, abs=1e-4)
    assert min(r.passes for r in plan.values()) == 1
    got = mix(rows, "source", "n", "k", block=16).collect()
    for source, p in plan.items():
        own = sorted((r for r in got if r.source == source), key=lambda r: (r["pass"], r.start, r.n))
        end = 0
        for r in own:  # gapless: the stream is a permutation, pass after pass
            assert r.start == end
            end += r.n
        assert end <= p.budget
        assert p.budget - end < 51 or source == "void"
        for number in range(int(p.passes)):
            assert sorted(r.k for r in own if r["pass"] == number) == sorted(k for k, s, _ in ROWS if s == source)
    assert [r.place for r in got if r.source == "void"] == [0.0]
    assert mix(rows.limit(0), "source", "n", "k").collect() == []


def test_entropy_target_and_given_budget(spark):
    rows = spark.createDataFrame(ROWS, "k long, source string, n int").where("source <> 'void' AND source IS NOT NULL")
    for goal in (0.8, 0.95, 1.0):
        q = [r.weight for r in weights(rows, "source", "n", max_repeats=None, entropy=goal).collect()]
        entropy = -sum(x * math.log(x) for x in q) / math.log(len(q))
        assert entropy == pytest.approx(goal, abs=1e-4) and entropy >= goal - 1e-9
    plan = weights(rows, "source", "n", max_repeats=1.5, budget=20_000).collect()
    assert abs(sum(r.budget for r in plan) - 20_000) <= len(plan)
    assert max(r.passes for r in plan) <= 1.5 + 1e-6
    with pytest.raises(ValueError):
        weights(rows, "source", "n", max_repeats=1.0, budget=10**9)


def plain_leaves(text):
    return [[hashlib.md5(x.encode()).hexdigest() for x in re.findall(LEAF, p)] for p in text.split("\n")]


ODD = [
    (5, "", 1), (3, None, 1), (3, None, 1), (9, " ", 2), (None, "no id", 0), (8, "x" * 30_000, 0), (2, "é 日本 😀. a b c d e f g\n\n c\r\n", 0),
    (7, "word. " * 9_000, 0), (4, "One two three. Four five six seven eight nine ten.\nSecond line here.", 0),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, edited int")
    got = edited(docs).collect()
    assert len(got) == len(ODD)
    order = sorted({(k, t or "") for k, t, _ in ODD}, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    for r in got:
        i = order.index((r.doc_id, r.text))
        after = order[(i + 1) % len(order)][1]
        n = len(r.text)
        assert r.n_chars == n
        assert r.edited == r.text[: n - n // 3] + after[: n // 3]
        assert "".join(r.fingerprint.split(":")[1].translate(str.maketrans(",;", "  ")).split()) == "".join(
            h[: merkle.SHORT] for p in plain_leaves(r.text) for h in p
        )
        assert "".join("".join(re.findall(LEAF, p)) for p in r.text.split("\n")) == r.text.replace("\n", "")
    assert edited(docs.limit(0)).collect() == []
    one = edited(docs.where("doc_id = 4")).first()
    assert one.edited == one.text[: len(one.text) - len(one.text) // 3] + one.text[: len(one.text) // 3]


def test_roots_branches_and_likeness(spark):
    base = "\n".join(f"Paragraph {i} has some words. And one more sentence {i * i}." for i in range(40))
    rows = [(0, base), (1, base), (2, base.replace("Paragraph 7 ", "Chapter 7 ")), (3, base + " "), (4, "x\n" + base), (5, "other text"), (6, ""), (7, "\n")]
    prints = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert found[0] == found[1]
    assert len({f.split(":")[0] for f in found.values()}) == 7
    pairs = spark.createDataFrame([(a, b, found[a], found[b]) for a in found for b in found], "a int, b int, x string, y string")
    got = {(r.a, r.b): r for r in pairs.select("a", "b", likeness(F.col("x"), F.col("y")).alias("like"), differing(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got[0, 1].like == 1 and got[0, 1].d == []
    assert got[0, 2].d == [7] and 0.95 < got[0, 2].like < 1
    assert got[4, 0].d == [0] and got[4, 0].like > 0.95
    assert got[0, 5].like == 0 and got[6, 7].like == 0 and got[6, 6].like == 1
    assert all(0 <= r.like <= 1 and r.like == got[r.b, r.a].like for r in got.values())


def test_columns_that_are_called_like_ours(spark):
    rows = spark.createDataFrame(ROWS[:500], "k long, source string, n int")
    plain = sorted(tuple(r) for r in mix(rows, "source", "n", "k", block=16).collect())
    names = ["pass", "start", "place", "budget", "__block", "__n", "__source", "weight"]
    more = rows.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    got = mix(more, "source", "n", "k", block=16)
    assert got.columns == [*more.columns, "pass_", "start_", "place_"]
    found = got.collect()
    assert all(r[c] == f"own {c}" for r in found for c in names)
    assert sorted((r.k, r.source, r.n, r.pass_, r.start_, r.place_) for r in found) == plain


def test_a_very_long_text_is_mixed(spark):
    rows = spark.createDataFrame([(1, "a", "word " * 400_000), (2, "a", None), (3, "b", "")], "doc_id long, source string, text string")
    counted = rows.withColumn("n", mixing.token_count(F.col("text")))
    got = mix(counted, "source", "n", "doc_id").collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(1, 400_000), (2, 0), (3, 0)]


def compared(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    pairs = spark.createDataFrame([(a, b, found[a], found[b]) for a in found for b in found], "a int, b int, x string, y string")
    got = pairs.select("a", "b", likeness(F.col("x"), F.col("y")).alias("like"), differing(F.col("x"), F.col("y")).alias("d")).collect()
    return {(r.a, r.b): (r.like, r.d) for r in got}


def test_order_and_repeats_count(spark):
    got = compared(spark, ["a\nb\na", "b\na\nb\nb", "one\ntwo\nthree", "two\none\nthree", "one\ntwo\nthree\nthree"])
    assert got[0, 1][0] == pytest.approx(2 * 2 / (3 + 4 + 2)) and got[0, 1][1] and got[1, 0][1]
    assert got[2, 3][0] < 1 and got[2, 3][1] == [0, 1] and got[3, 2][1] == [0, 1]  # swapped lines
    assert got[4, 2][1] == [3] and got[4, 2][0] < 1  # a repeated line
    assert all(like == 1 and d == [] for (a, b), (like, d) in got.items() if a == b)


def test_moved_and_edited_paragraphs_are_located(spark):
    lines = [f"Paragraph {i} says {i * i} things about topic {i % 5}." for i in range(200)]
    moved = lines[:50] + lines[51:80] + [lines[50]] + lines[80:]
    twice = lines[:120] + [lines[10]] + lines[120:]
    two = list(lines)
    two[30], two[170] = "Edited line thirty.", "Edited line far below."
    got = compared(spark, ["\n".join(x) for x in (lines, moved, twice, two)])
    assert set(got[0, 1][1]) == set(range(50, 80)) and set(got[1, 0][1]) == set(range(50, 80))
    assert got[2, 0][1] == [120] and got[0, 2][1] == []
    assert got[0, 3][1] == [30, 170] and got[3, 0][1] == [30, 170]
    assert all(0.9 < like <= 1 for like, _ in got.values())
