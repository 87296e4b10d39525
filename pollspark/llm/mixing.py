"""Mixing sources to target weights, by built-in functions only.

Weights are the sources' token shares to the power of an exponent between 0 (all
alike) and 1 (as found). The exponent is bisected on one aggregate row per trial
value, 63 trial values in one pass, until it meets a repetition limit (the flattest
mix in which no source is read more often) or a target entropy (the mix nearest to
the found one that is flat enough); with both, the limit holds.

A source's budget of tokens is read as passes over its rows. A pass is a permutation
of blocks and of the rows inside a block, both by hash; the last pass stops at the
budget. Blocks hold some ``BLOCK`` rows whatever the source's size, so the largest
source is spread over most tasks; only block totals are summed along a source.

Cases: a null source is a source; a null text has no tokens; a source without tokens
gets weight 0 and its rows are read once; repeated rows are read as often as they
occur; an empty table gives no rows. Further columns are passed through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.llm.common import as_one, free, table
from pollspark.session import materialise

BLOCK = 4096
SEED = 11
#: Production limit: no source is read more than twice as often as the least repeated one.
MAX_REPEATS = 2.0
#: Trial exponents of a pass and passes; together they narrow the interval to 2 ** -36.
TRIALS, ROUNDS = 63, 6
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _trial_rows(totals: DataFrame, lo: float, hi: float, budget: int | None) -> list:
    """For exponents inside (lo, hi): entropy of the weights and the most passes over a source."""
    step = (hi - lo) / (TRIALS + 1)
    exponents = F.array(*[F.lit(lo + step * (i + 1)) for i in range(TRIALS)])
    ratio = F.col("__share") / F.col("__largest")
    tried = totals.select("__share", ratio.alias("__ratio"), F.explode(exponents).alias("tau"))
    power = F.pow(F.col("__ratio"), F.col("tau"))
    sums = tried.groupBy("tau").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.log("__ratio")).alias("s"),
        F.max(F.pow(F.col("__ratio"), F.col("tau") - 1)).alias("steepest"),
        F.first("__share").alias("__any"), F.first("__ratio").alias("__any_ratio"),
    )
    # Passes over source i: budget * ratio_i ** tau / z / tokens_i; without a budget the largest source is read once.
    largest = F.col("__any") / F.col("__any_ratio")
    repeats = F.col("steepest") if budget is None else F.lit(float(budget)) * F.col("steepest") / F.col("z") / largest
    return sums.select("tau", (F.log("z") - F.col("tau") * F.col("s") / F.col("z")).alias("entropy"), repeats.alias("repeats")).orderBy("tau").collect()


def solve_exponent(
    totals: DataFrame, max_repeats: float | None, entropy: float | None, budget: int | None
) -> float:
    """Exponent for sources with ``__share`` tokens (all positive). ``entropy`` is a part of the greatest possible, 0 to 1."""
    totals = totals.select(F.col("__share").cast("double").alias("__share"))
    n, largest, tokens = totals.agg(F.count(F.lit(1)), F.max("__share"), F.sum("__share")).first()
    if not n:
        return 1.0
    totals = totals.withColumn("__largest", F.lit(largest))

    def bisect(holds, keeps_high: bool) -> float:
        """End of the interval on which ``holds`` turns; it holds towards 1 if ``keeps_high``, else towards 0."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = _trial_rows(totals, lo, hi, budget)
            good = [r.tau for r in rows if holds(r)]
            bad = [r.tau for r in rows if not holds(r)]
            if keeps_high:
                lo, hi = max([lo, *bad]), min([hi, *good])
            else:
                lo, hi = max([lo, *good]), min([hi, *bad])
        return math.ceil(hi * 1e6) / 1e6 if keeps_high else math.floor(lo * 1e6) / 1e6

    low = 0.0
    if max_repeats is not None:
        if max_repeats < (1 if budget is None else budget / tokens):
            raise ValueError("the budget cannot be read within the repetition limit")
        low = bisect(lambda r: r.repeats <= max_repeats, True)
    if entropy is not None:
        return max(low, bisect(lambda r: r.entropy >= entropy * math.log(n) - 1e-12, False))
    return low if max_repeats is not None else 1.0


def weights(
    rows: DataFrame, source: str, tokens: str, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
    budget: int | None = None,
) -> DataFrame:
    """``(source, __tokens, __rows, weight, passes, budget)`` of each source.

    Without ``budget`` it is the least with which every source is read once or more,
    so that no row is lost.
    """
    totals = materialise(rows.groupBy(F.col(source).alias("__source")).agg(F.sum(tokens).alias("__tokens"), F.count(F.lit(1)).alias("__rows")))
    some = totals.where("__tokens > 0").select(F.col("__tokens").alias("__share"))
    tau = solve_exponent(some, max_repeats, entropy, budget)
    largest = some.agg(F.max("__share")).first()[0] or 1
    ratio = F.col("__tokens") / F.lit(float(largest))
    power = F.when(F.col("__tokens") > 0, F.pow(ratio, F.lit(tau))).otherwise(0.0)
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    passes = F.pow(ratio, F.lit(tau - 1)) if budget is None else F.lit(float(budget) / z) * power / F.col("__tokens")
    passes = F.when(F.col("__tokens") > 0, F.round(passes, 9)).otherwise(1.0)
    return totals.select(
        "__source", "__tokens", "__rows", F.round(power / z, 12).alias("weight"), passes.alias("passes"),
        F.floor(passes * F.col("__tokens") + 1e-6).cast("long").alias("budget"),
    )


def _dice(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def mix(
    rows: DataFrame, source: str, tokens: str, key: str, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
    budget: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """``rows`` as often as their source's budget asks, with ``pass``, ``start`` and ``place``.

    ``start`` is the row's place in its source's stream, in tokens; ``place`` is that
    over the budget, so sorting by ``place`` interleaves the sources at their weights
    in every prefix. ``key`` is what the permutation hashes. ``rows`` is read three times.
    Where ``rows`` has a column of such a name, it stays and ours gets an underscore more.
    The running sum over a pass's blocks is one task's work: one row for ``block`` rows.
    """
    names = [free(n, rows.columns) for n in ("pass", "start", "place")]
    rows = as_one(rows, __own=source, __n=tokens, __key=key)
    plan = materialise(weights(rows, "__own", "__n", max_repeats, entropy, budget))
    plan = plan.select(
        "__source", "__tokens", F.col("budget").alias("__budget"), F.ceil(F.col("__rows") / block).cast("long").alias("__blocks"),
        F.when(F.col("__tokens") > 0, F.floor(F.col("budget") / F.col("__tokens"))).otherwise(1).cast("long").alias("__full"),
        F.when(F.col("__tokens") > 0, F.pmod(F.col("budget"), F.col("__tokens"))).otherwise(0).cast("long").alias("__rest"),
    )
    joined = rows.join(plan, F.col("__own").eqNullSafe(F.col("__source")))
    dealt = joined.withColumn(
        "__block", F.pmod(F.conv(F.substring(_dice(F.col("__key")), 1, 8), 16, 10).cast("long"), F.col("__blocks"))
    )
    last = F.col("__full") + (F.col("__rest") > 0).cast("long") - 1
    passes = F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>")))
    sums = (
        dealt.groupBy("__source", "__block", "__full", "__rest").agg(F.sum("__n").alias("__sum"))
        .withColumn("__pass", passes).select("__source", "__pass", "__block", "__sum")
    )
    order = Window.partitionBy("__source", "__pass").orderBy(_dice(F.col("__pass"), F.lit("block"), F.col("__block")), "__block")
    before = sums.select(
        F.col("__source").alias("__s"), F.col("__pass").alias("__p"), F.col("__block").alias("__b"),
        (F.sum("__sum").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"),
    )
    copies = dealt.withColumn("__pass", passes).join(
        before, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__pass") == F.col("__p")) & (F.col("__block") == F.col("__b"))
    )
    within = Window.partitionBy("__source", "__pass", "__block").orderBy(_dice(F.col("__pass"), F.col("__key")), "__key", "__n")
    end = F.col("__before") + F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    start = F.col("__pass") * F.col("__tokens") + F.col("__end") - F.col("__n")
    place = F.when(F.col("__budget") > 0, start / F.col("__budget")).otherwise(0.0)
    return (
        copies.withColumn("__end", end)
        .where((F.col("__pass") < F.col("__full")) | (F.col("__end") <= F.col("__rest")))
        .select("__row.*", *[c.alias(n) for c, n in zip((F.col("__pass"), start, place), names, strict=True)])
    )


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed order of all documents: flattest weights within the repetition limit, every document at least once."""
    docs = table(spark, sf_dir, "documents")
    light = materialise(docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")))
    return mix(light, "source", "n_tokens", "doc_id")


_DICE = "('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_rows FROM d GROUP BY source),
ends AS (SELECT CAST(min(tokens) AS DOUBLE) / max(tokens) AS least, CAST(max(tokens) AS DOUBLE) AS largest FROM t WHERE tokens > 0),
halves AS (
  SELECT 0 AS i, 0.0E0 AS lo, 1.0E0 AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN pow(least, (lo + hi) / 2 - 1) <= {MAX_REPEATS}E0 THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(least, (lo + hi) / 2 - 1) <= {MAX_REPEATS}E0 THEN (lo + hi) / 2 ELSE hi END
  FROM halves, ends WHERE i < 36),
tau AS (SELECT ceil(hi * 1E6) / 1E6 AS tau FROM halves WHERE i = 36),
p AS (SELECT source, tokens, CAST(ceil(n_rows / {BLOCK}.0E0) AS BIGINT) AS blocks,
             CASE WHEN tokens > 0 THEN round(pow(tokens / largest, tau - 1), 9) ELSE 1.0E0 END AS passes FROM t, ends, tau),
b AS (SELECT source, tokens, blocks, CAST(floor(passes * tokens + 1E-6) AS BIGINT) AS budget FROM p),
g AS (SELECT d.*, tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS n_full,
             CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest, {_DICE} % blocks AS block
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
c AS (SELECT g.*, unnest(range(n_full + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS pass FROM g),
s AS (SELECT source, pass, block, sum(n_tokens) AS tokens FROM c GROUP BY ALL),
o AS (SELECT source, pass, block, sum(tokens) OVER (PARTITION BY source, pass
        ORDER BY md5('11:' || pass || ':block:' || block), block ROWS UNBOUNDED PRECEDING) - tokens AS before FROM s),
e AS (SELECT c.*, before + sum(n_tokens) OVER (PARTITION BY c.source, c.pass, c.block
        ORDER BY md5('11:' || c.pass || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS stop
      FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source AND c.pass = o.pass AND c.block = o.block)
SELECT doc_id, source, n_tokens, pass, CAST(pass * tokens + stop - n_tokens AS BIGINT) AS start,
       CASE WHEN budget > 0 THEN CAST(pass * tokens + stop - n_tokens AS BIGINT) / CAST(budget AS DOUBLE) ELSE 0.0E0 END AS place
FROM e WHERE pass < n_full OR stop <= rest"""
