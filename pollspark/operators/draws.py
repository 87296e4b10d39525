"""Summaries and convergence of posterior draws ``(variable, chain, iteration, value)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark.functions.columns import normal_quantile
from pollspark.operators.ranking import average_ranks, quantiles
from pollspark.operators.relate import inner_join, left_join, union_all
from pollspark.session import materialise

# Fixed value: scale that makes the median absolute deviation consistent for a normal sample.
MAD_SCALE = 1.4826
BLOCK = 512
#: Lags of the first round.
FIRST_LAGS = 32


def summarise_draws(draws: DataFrame) -> DataFrame:
    """Mean, median, sd, mad and 5% and 95% quantiles per variable."""
    moments = draws.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    marks = materialise(quantiles(draws, "value", [0.05, 0.5, 0.95], ["variable"], ["q5", "median", "q95"]))
    apart = left_join(draws, marks.select("variable", "median"), "variable").select(
        "variable", F.abs(F.col("value") - F.col("median")).alias("dev")
    )
    mad = quantiles(apart, "dev", [0.5], ["variable"], ["mad"]).withColumn("mad", F.col("mad") * MAD_SCALE)
    joined = inner_join(inner_join(moments, marks, ["variable"]), mad, ["variable"])
    return joined.select("variable", "mean", "median", "sd", "mad", "q5", "q95")


def split_chains(draws: DataFrame) -> DataFrame:
    """Halve each chain: ``(variable, half, pos, value)``, the middle draw of an odd chain left out."""
    length = draws.groupBy("variable", "chain").agg(F.max("iteration").alias("n"))
    joined = left_join(draws, length, ["variable", "chain"])
    size = F.floor(F.col("n") / 2)
    second = F.col("iteration") > F.col("n") - size
    return joined.where((F.col("iteration") <= size) | second).select(
        "variable",
        (F.col("chain") * 2 + second.cast("int")).alias("half"),
        F.when(second, F.col("iteration") - (F.col("n") - size)).otherwise(F.col("iteration")).alias("pos"),
        "value",
    )


def chain_moments(halves: DataFrame) -> DataFrame:
    return halves.groupBy("variable", "half").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")
    )


def _variance_parts(moments: DataFrame) -> DataFrame:
    """Per variable: chains, mean, shortest and total draws, within and pooled variance.

    Chains of any length are used whole: variances are weighted by their degrees of
    freedom, squared distances of chain means by the chains' draws. With equal
    lengths these are the plain means.
    """
    centres = moments.groupBy("variable").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"))
    apart = F.col("m") - F.col("centre")
    parts = inner_join(moments, centres, ["variable"]).groupBy("variable").agg(
        F.count(F.lit(1)).alias("chains"),
        F.avg("n").alias("n"),
        F.min("n").alias("shortest"),
        F.sum("n").alias("total"),
        F.try_divide(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1)).alias("within"),
        F.try_divide(F.sum(F.col("n") * apart * apart), (F.count(F.lit(1)) - 1) * F.avg("n")).alias("between"),
    )
    n = F.col("n")
    return parts.withColumn("pooled", (n - 1) / n * F.col("within") + F.col("between"))


def split_rhat(draws: DataFrame) -> DataFrame:
    """Plain split R-hat: aggregates only."""
    parts = _variance_parts(chain_moments(split_chains(draws)))
    return parts.select("variable", F.sqrt(F.try_divide(F.col("pooled"), F.col("within"))).alias("rhat"))


def rank_normalise(halves: DataFrame) -> DataFrame:
    """Replace values by normal scores of their ranks in the variable (mean rank for ties)."""
    total = halves.groupBy("variable").agg(F.count("value").alias("s"))
    ranks = left_join(average_ranks(halves, "value", ["variable"]), total, "variable")
    score = normal_quantile((F.col("rank") - 0.375) / (F.col("s") + 0.25))
    scores = ranks.select("variable", "value", score.alias("z"))
    return left_join(halves, scores, ["variable", "value"]).withColumn("value", F.col("z")).drop("z")


def _autocovariance(blocks: DataFrame, lags: range, block: int) -> DataFrame:
    """``(variable, lag, s)``: lagged product sums over all chains, for ``lags`` that begin in one block.

    Each row holds a block and the two that its lags reach, so memory does not depend on
    the length of a chain.
    """
    shift = lags.start // block
    follow = blocks.select("variable", "half", "block", F.col("values").alias("near"))
    near = follow.withColumn("block", F.col("block") - shift)
    far = follow.select("variable", "half", (F.col("block") - shift - 1).alias("block"), F.col("near").alias("far"))
    keys = ["variable", "half", "block"]
    joined = blocks.withColumnRenamed("values", "own").join(near, keys, "inner").join(far, keys, "left")
    rows = joined.select("variable", "own", F.concat("near", F.coalesce("far", F.array().cast("array<double>"))).alias("ahead"))

    def product(lag: Column) -> Column:
        beside = F.slice("ahead", lag - shift * block + 1, F.size("own"))
        both = F.zip_with("own", beside, lambda x, y: x * F.coalesce(y, F.lit(0.0)))
        return F.aggregate(both, F.lit(0.0), lambda total, x: total + x)

    each = F.transform(F.sequence(F.lit(lags.start), F.lit(lags.stop - 1)), lambda lag: F.struct(lag.cast("long").alias("lag"), product(lag).alias("s")))
    return rows.select("variable", F.inline(each)).groupBy("variable", "lag").agg(F.sum("s").alias("s"))


def _rounds(longest: int, block: int) -> Iterator[range]:
    """Lags of each round: a few first, since most sequences end early, then the rest block by block."""
    first = min(FIRST_LAGS, block)
    yield range(first)
    if first < block:
        yield range(first, block)
    for shift in range(1, longest + 1):
        yield range(shift * block, (shift + 1) * block)


def effective_size(halves: DataFrame, block: int = BLOCK) -> DataFrame:
    """Effective sample size per variable from split chains.

    Lags go up to the shortest chain; products of longer chains count by their draws.

    Autocorrelations are summed in pairs up to the first negative pair, each pair
    capped by the smallest before it (Geyer's initial monotone sequence). Lags
    come in blocks; a further block is computed only for variables whose sequence
    has not ended yet. A constant variable has no effective size.
    """
    moments = chain_moments(halves)
    parts = materialise(_variance_parts(moments))
    varied = parts.where(F.col("within") > 0)
    blocks = materialise(
        inner_join(halves, moments.select("variable", "half", "m"), ["variable", "half"])
        .groupBy("variable", "half", F.floor((F.col("pos") - 1) / block).alias("block"))
        .agg(F.array_sort(F.array_agg(F.struct("pos", (F.col("value") - F.col("m")).alias("x")))).alias("xs"))
        .select("variable", "half", "block", F.col("xs.x").alias("values"))
    )
    longest = blocks.agg(F.max("block")).first()[0] or 0
    done, pending, history = [], None, None
    for lags in _rounds(longest, block):
        open_blocks = blocks if pending is None else inner_join(blocks, pending, ["variable"])
        per_lag = _autocovariance(open_blocks, lags, block)
        rho = 1 - (F.col("within") - F.col("s") / F.col("total")) / F.col("pooled")
        found = inner_join(per_lag, varied, ["variable"]).where(F.col("lag") < F.col("shortest"))
        found = found.select("variable", "lag", F.when(F.col("lag") == 0, 1.0).otherwise(rho).alias("rho"), "shortest")
        if history is not None:
            found = union_all(inner_join(history, pending, ["variable"]), found)
        history = materialise(found)
        state = _geyer(history, lags.stop)
        done.append(state.where("finished"))
        pending = state.where(~F.col("finished")).select("variable")
        if pending.isEmpty():
            break
    joined = left_join(parts, union_all(*done).select("variable", "tau"), "variable")
    total = F.col("total")
    # Lower bound of the autocorrelation time, for antithetic chains.
    bounded = F.greatest(F.col("tau"), 1 / F.log10(total.cast("double")))
    return joined.select("variable", F.when(F.col("tau").isNotNull(), total / bounded).alias("ess"))


def _geyer(rho: DataFrame, known: int) -> DataFrame:
    """Autocorrelation time per variable, and whether the known lags settle it.

    The pairs of one variable form an array of at most ``known / 2`` numbers.
    The pair that ends the sequence adds its even member only.
    """
    sized = rho.groupBy("variable", F.col("shortest").alias("n"), F.floor(F.col("lag") / 2).alias("pair")).agg(
        F.sum("rho").alias("sum"),
        F.max(F.when(F.col("lag") % 2 == 0, F.col("rho"))).alias("even"),
        F.count(F.lit(1)).alias("c"),
    )
    # Lags too close to the chain length are not used.
    usable = sized.where((F.col("c") == 2) & ((F.col("pair") == 0) | (2 * F.col("pair") < F.col("n") - 3)))
    listed = usable.groupBy("variable", "n").agg(F.array_sort(F.array_agg(F.struct("pair", "sum", "even"))).alias("ps"))
    start = F.struct(
        F.lit(0.0).alias("total"),
        F.lit(float("inf")).alias("low"),
        F.lit(0.0).alias("even"),
        F.lit(False).alias("ended"),
    )

    def step(acc, p):
        ends = ~acc["ended"] & (p["sum"] < 0)
        open_ = ~acc["ended"] & ~ends
        low = F.least(acc["low"], p["sum"])
        return F.struct(
            F.when(open_, acc["total"] + low).otherwise(acc["total"]).alias("total"),
            F.when(open_, low).otherwise(acc["low"]).alias("low"),
            F.when(ends, F.greatest(p["even"], F.lit(0.0))).when(open_, p["even"]).otherwise(acc["even"]).alias("even"),
            (acc["ended"] | ends).alias("ended"),
        )

    walked = listed.withColumn("r", F.aggregate("ps", start, step))
    total = F.col("r.total") - F.when(F.col("r.ended"), 0.0).otherwise(F.col("r.low"))
    return walked.select(
        "variable",
        (-1 + 2 * total + F.col("r.even")).alias("tau"),
        (F.col("r.ended") | (F.col("n") <= known)).alias("finished"),
    )


def _series(df: DataFrame, kind: str, value: Column) -> DataFrame:
    """The same draws as a further series: ``kind`` goes in front of the variable name."""
    return df.select(F.concat(F.lit(kind + ":"), "variable").alias("variable"), "half", "pos", value.alias("value"))


def _by_kind(df: DataFrame, value: str, *kinds: str) -> DataFrame:
    """One row a variable with a column for each kind of its series."""
    split = F.split("variable", ":", 2)
    chosen = [F.max(F.when(F.col("kind") == k, F.col(value))).alias(k) for k in kinds]
    return df.select(split[0].alias("kind"), split[1].alias("variable"), value).groupBy("variable").agg(*chosen)


def convergence(draws: DataFrame) -> DataFrame:
    """Rank-normalised split R-hat, bulk and tail effective size per variable.

    Chains may differ in length. The derived series (ranks, distances from the median, tail indicators) go
    through each step together.
    """
    marks = materialise(quantiles(draws, "value", [0.05, 0.5, 0.95], ["variable"], ["q5", "median", "q95"]))
    marked = materialise(left_join(split_chains(draws), marks, "variable"))
    value = F.col("value")
    ranked = materialise(
        rank_normalise(
            union_all(_series(marked, "bulk", value), _series(marked, "folded", F.abs(value - F.col("median"))))
        )
    )
    parts = _variance_parts(chain_moments(ranked))
    ratios = parts.select("variable", F.sqrt(F.try_divide(F.col("pooled"), F.col("within"))).alias("rhat"))
    tails = [_series(marked, q, (value <= F.col(q)).cast("double")) for q in ("q5", "q95")]
    bulk = ranked.where(F.col("variable").startswith("bulk:"))
    sizes = effective_size(union_all(bulk, *tails))
    ratio, size = _by_kind(ratios, "rhat", "bulk", "folded"), _by_kind(sizes, "ess", "bulk", "q5", "q95")
    joined = inner_join(ratio.withColumnsRenamed({"bulk": "r_bulk", "folded": "r_folded"}), size, ["variable"])
    return joined.select(
        "variable",
        F.greatest("r_bulk", "r_folded").alias("rhat"),
        F.col("bulk").alias("ess_bulk"),
        F.least("q5", "q95").alias("ess_tail"),
    )
