"""How many dimensions the answers have: item means, correlations, eigenvalues, factors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.operators.aggregate import correlation
from pollspark.operators.clean import complete_cases
from pollspark.operators.relate import left_join
from pollspark.operators.shape import NOISE, pivot_longer, standardise
from pollspark.session import materialise


def country_item_means(answers: DataFrame, items: Sequence[str], unit: str, period: str) -> DataFrame:
    """Item means by country and period, standardised inside the period, averaged by country.

    ``answers`` is the wide microdata; the result is long ``(unit, question, val)``.
    """
    wide = answers.groupBy(unit, period).agg(*[F.avg(c).alias(c) for c in items])
    long = pivot_longer(wide, [unit, period], items, "question", "val").where(F.col("val").isNotNull())
    scaled = standardise(long, "val", ["question", period], "scaled")
    return scaled.groupBy(unit, "question").agg(F.avg("scaled").alias("val"))


def item_pairs(entries: Column) -> Column:
    """Rows (name_a, name_b, a, b) of all unordered pairs of an array of (name, value), each with itself too."""
    return F.explode(
        F.flatten(
            F.transform(
                entries,
                lambda x, i: F.transform(
                    F.slice(entries, i + 1, F.size(entries)),
                    lambda y: F.struct(x["name"].alias("name_a"), y["name"].alias("name_b"), x["value"].alias("a"), y["value"].alias("b")),
                ),
            )
        )
    )


def corr_matrix(long: DataFrame, unit: str, item: str, val: str, items: Sequence[str], skip_first: bool = False) -> DataFrame:
    """Pairwise-complete correlations of items, long ``(item_a, item_b, corr)``.

    One scan: a unit's items become one array, its pairs are added up per pair of
    items before the shuffle, so units are never paired with each other and the plan
    does not grow with the number of items. ``skip_first`` leaves out the first item.
    """
    used = list(items)[1:] if skip_first else list(items)
    listed = F.array(*[F.lit(i) for i in used])
    one = long.where(F.col(item).isin(used)).groupBy(unit, item).agg(F.max(val).cast("double").alias("value"))
    entry = F.struct(F.array_position(listed, F.col(item)).alias("at"), F.col(item).alias("name"), "value")
    wide = one.where(F.col("value").isNotNull()).groupBy(unit).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    pairs = wide.select(item_pairs(F.col("entries")).alias("p")).select("p.*")
    same = F.col("name_a") == F.col("name_b")
    half = pairs.groupBy("name_a", "name_b").agg(correlation("a", "b").alias("c"), F.var_pop("a").alias("v"))
    half = half.select("name_a", "name_b", F.when(same, F.when(F.col("v") > 0, 1.0)).otherwise(F.col("c")).alias("corr"))
    mirrored = half.where(~same).select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "corr")
    # Pairs that no unit has are listed too.
    grid = long.sparkSession.range(1).select(F.explode(listed).alias("item_a")).select("item_a", F.explode(listed).alias("item_b"))
    return left_join(grid, half.unionByName(mirrored), [("item_a", "name_a"), ("item_b", "name_b")])


def mean_correlation(matrix: DataFrame, digits: int = 2) -> DataFrame:
    """Mean correlation per item (its own 1 included), and the label ``item: mean``."""
    mean = matrix.groupBy("item_b").agg(F.bround(F.avg("corr"), digits).alias("cor"))
    label = F.concat_ws(": ", F.col("item_b"), F.col("cor").cast("string"))
    return mean.select(F.col("item_b").alias("item"), "cor", label.alias("label"))


def positive_items(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that vary and whose total is positive; one row of totals comes back."""
    row = df.agg(*[F.struct(F.sum(c).alias("t"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c].t is not None and row[c].t > 0 and row[c].lo < row[c].hi]


def _spread(col: str) -> Column:
    """Sample deviation; missing where it is no more than rounding noise."""
    sd = F.stddev_samp(col)
    return F.when(sd > NOISE * F.max(F.abs(F.col(col))), sd)


def screen_items(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Positive-total columns, complete rows, standardised; with the column list."""
    kept = positive_items(df, cols)
    rows = complete_cases(df.select(*[F.col(c).cast("double").alias(c) for c in kept]))
    moments = rows.agg(*[F.struct(F.avg(c).alias("m"), _spread(c).alias("s")).alias(c) for c in kept])
    stats = moments.select(F.struct(*kept).alias("row")).scalar()
    scaled = rows.withColumn("__s", stats)
    centred = [
        F.when(F.col(f"__s.{c}.s") > 0, (F.col(c) - F.col(f"__s.{c}.m")) / F.col(f"__s.{c}.s")).alias(c) for c in kept
    ]
    return scaled.select(*centred), kept


def eigenvalues(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Eigenvalues of the correlation matrix, largest first.

    The matrix is summed over the cluster; only its p x p numbers reach the driver.
    """
    features = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="error").transform(df)
    matrix = Correlation.corr(features.select("features"), "features").first()[0].toArray()
    return sorted(np.linalg.eigvalsh(matrix).tolist(), reverse=True)


def eigen_table(spark: SparkSession, values: Sequence[float]) -> DataFrame:
    rows = [(i + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rank int, eigenvalue double")


def parallel_analysis(
    spark: SparkSession, n: int, p: int, reps: int = 100, cent: float = 0.05, seed: int = 1
) -> DataFrame:
    """Eigenvalue quantile by rank over ``reps`` random normal tables of ``n`` rows and ``p`` columns.

    The scatter matrix of a normal table is drawn directly (Bartlett's
    triangular form), so a replicate costs p x p numbers whatever ``n`` is. Each
    replicate has its own seed and does not depend on the partitioning.
    """
    if n <= p:
        raise ValueError("need more rows than columns")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rep in pdf["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                factor = np.tril(rng.standard_normal((p, p)), -1)
                factor[np.diag_indices(p)] = np.sqrt(rng.chisquare(n - 1 - np.arange(p)))
                scatter = factor @ factor.T
                scale = np.sqrt(np.diag(scatter))
                values = np.linalg.eigvalsh(scatter / np.outer(scale, scale))[::-1]
                yield pd.DataFrame({"rank": np.arange(1, p + 1), "value": values})

    draws = spark.range(reps).mapInPandas(replicate, "rank int, value double")
    # Every rank has exactly ``reps`` values.
    return draws.groupBy("rank").agg(
        F.percentile("value", F.lit(cent)).alias("parallel"), F.avg("value").alias("parallel_mean")
    )


def permuted_analysis(
    df: DataFrame, cols: Sequence[str], reps: int = 100, cent: float = 0.05, seed: int = 1, block: int = 4096
) -> DataFrame:
    """Eigenvalue quantile by rank over ``reps`` copies of the table whose columns are permuted on their own.

    Rows are dealt at random into blocks of at most ``block`` and each column of a block is
    shuffled, which breaks the columns' ties with each other and keeps their values. Every
    replicate's p x p products are summed over the blocks, so all come from one pass over
    the rows; tables with fewer rows than columns are allowed. Constant columns have no part.
    """
    p = len(cols)
    wide = [F.col(c).cast("double").alias(c) for c in cols]
    rows = materialise(complete_cases(df.select(*wide)).withColumn("__id", F.monotonically_increasing_id()))
    order = F.xxhash64(F.lit(seed), "__id")
    dealt = rows.repartition(order).sortWithinPartitions(order, "__id").select(*cols)

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held = np.zeros((0, p))
        sums = np.zeros((reps, 1 + p + p * p))

        def take(x: np.ndarray) -> None:
            nonlocal number
            for rep in range(reps):
                y = np.random.default_rng([seed, part, number, rep]).permuted(x, axis=0)
                sums[rep] += np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
            number += 1

        for batch in batches:
            held = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            while len(held) >= block:
                take(held[:block])
                held = held[block:]
        if len(held):
            take(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["rep", "sums"])

    def roots(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.asarray(x.as_py()) for x in parts.column("sums"))
        n, s, xx = total[0], total[1 : 1 + p], total[1 + p :].reshape(p, p)
        cov = xx - np.outer(s, s) / max(n, 1)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        some = scale > 1e-12 * np.sqrt(np.maximum(np.diag(xx), 0))
        found = np.zeros(0)
        if some.any():
            found = np.linalg.eigvalsh(cov[np.ix_(some, some)] / np.outer(scale[some], scale[some]))[::-1]
        return pa.table({"rank": pa.array(np.arange(1, len(found) + 1), pa.int32()), "value": found})

    # A replicate's rows are as many as there are partitions, each p x p numbers.
    sums = dealt.mapInArrow(shuffled, "rep int, sums array<double>")
    draws = sums.groupBy("rep").applyInArrow(roots, "rank int, value double")
    return draws.groupBy("rank").agg(
        F.percentile("value", F.lit(cent)).alias("parallel"), F.avg("value").alias("parallel_mean")
    )


def n_factors(eigen: DataFrame, parallel: DataFrame) -> DataFrame:
    """Number of factors by four rules, one row.

    Kaiser: eigenvalues of at least their mean. Parallel: leading run above the
    random ones. Optimal coordinates: leading run that is also above the line
    through the next and the last eigenvalue. Acceleration: rank before the
    sharpest bend, among ranks whose predecessor passes the parallel rule.
    All steps work on the p rows of the eigenvalue table.
    """
    table = eigen.join(parallel.select("rank", "parallel"), "rank")
    one = Window.partitionBy(F.lit(0))
    ranked = one.orderBy("rank")
    p = F.count(F.lit(1)).over(one)
    final = F.max_by("eigenvalue", "rank").over(one)
    after = F.lead("eigenvalue").over(ranked)
    rows = table.select(
        "rank",
        "eigenvalue",
        "parallel",
        F.avg("eigenvalue").over(one).alias("mean"),
        p.alias("p"),
        final.alias("final"),
        after.alias("after"),
        (after - 2 * F.col("eigenvalue") + F.lag("eigenvalue").over(ranked)).alias("bend"),
        (F.lag("eigenvalue").over(ranked) >= F.lag("parallel").over(ranked)).alias("before_ok"),
    )
    # Line through (rank + 1, after) and (p, final), read at rank; flat when both are one point.
    line = F.col("after") - F.coalesce(
        F.try_divide(F.col("final") - F.col("after"), F.col("p") - F.col("rank") - 1), F.lit(0.0)
    )
    above = F.col("eigenvalue") >= F.col("parallel")
    smooth = F.col("rank") < F.col("p")
    fails_par = F.min(F.when(~above, F.col("rank")))
    fails_oc = F.min(F.when(~(above & smooth & (F.col("eigenvalue") >= line)), F.col("rank")))
    sharpest = F.max_by("rank", F.when(F.col("before_ok"), F.col("bend")))
    return rows.agg(
        F.sum((F.col("eigenvalue") >= F.col("mean")).cast("int")).alias("kaiser"),
        (F.coalesce(fails_par, F.max("rank") + 1) - 1).alias("parallel"),
        (F.coalesce(fails_oc, F.max("rank") + 1) - 1).alias("optimal_coordinates"),
        (sharpest - 1).alias("acceleration"),
    )
