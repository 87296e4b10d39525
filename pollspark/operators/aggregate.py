"""Grouped summaries of answers, cells and estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark.operators.relate import full_join, left_join, union_all
from pollspark.operators.shape import pivot_longer


def tally(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def n_unique(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct non-missing values per column, one row.

    One scan: the distinct combinations are found first, map-side, and only they
    are expanded per column.
    """
    combinations = df.select(*cols).distinct()
    return combinations.agg(*[F.count_distinct(c).alias(c) for c in cols])


#: Codes that one bitmap holds, and bitmaps of a column that one aggregate may build side by side.
BITS, BESIDE = 32768, 16


def bitmaps(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact sets of dense integer codes (``encode``) as bitmaps: ``(by, bucket, cols)``, null where a column has none.

    One aggregate over the rows. Bitmaps of parts of a table, stored as they come in,
    are merged by ``bitmap_distinct``. Missing and negative codes are in no set.
    """
    largest = df.agg(*[F.max(c).alias(c) for c in cols]).first()
    buckets = 1 + max([0, *[largest[c] // BITS for c in cols if largest[c] is not None]])
    known = [F.when(F.col(c) >= 0, F.col(c).cast("long")) for c in cols]
    # ``bitmap_bucket_number`` counts from 1 and deals out 1..32768, so codes from 0 are moved by one.
    bucket = [F.bitmap_bucket_number(k + 1) - 1 for k in known]
    bit = [F.bitmap_bit_position(k + 1) for k in known]
    if buckets <= BESIDE:
        sets = [
            F.array(*[F.bitmap_construct_agg(F.when(g == b, p)) for b in range(buckets)]).alias(c)
            for c, g, p in zip(cols, bucket, bit, strict=True)
        ]
        wide = df.groupBy(*by).agg(*sets)
        each = F.posexplode(F.arrays_zip(*cols)).alias("bucket", "__sets")
        return wide.select(*by, each).select(*by, F.col("bucket").cast("long").alias("bucket"), *[F.col(f"__sets.{c}").alias(c) for c in cols])
    # Many codes: a row is dealt to the bucket of each of its columns.
    entries = F.array(*[F.struct(F.lit(c).alias("col"), g.alias("bucket"), p.alias("bit")) for c, g, p in zip(cols, bucket, bit, strict=True)])
    long = df.select(*by, F.explode(entries).alias("e")).select(*by, "e.*").where(F.col("bucket").isNotNull())
    return long.groupBy(*by, "bucket").agg(*[F.bitmap_construct_agg(F.when(F.col("col") == c, F.col("bit"))).alias(c) for c in cols])


def bitmap_distinct(sets: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct codes per group from ``bitmaps`` of any number of parts."""
    merged = sets.groupBy(*by, "bucket").agg(*[F.bitmap_or_agg(c).alias(c) for c in cols])
    return merged.groupBy(*by).agg(*[F.sum(F.bitmap_count(c)).alias(c) for c in cols])


def count_answers(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Answers per group and question, long form; a question never asked gives 0."""
    wide = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])
    return pivot_longer(wide, keys, cols, "question", "size")


def mean_answers(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean answer per group and question, long form; missing when nobody answered."""
    wide = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
    return pivot_longer(wide, keys, cols, "question", "avg_resp")


def answer_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count of answers and mean of non-negative answers per group and question, in one pass.

    Same rows as ``count_answers`` joined to ``mean_answers`` after ``null_negative``.
    """
    per_col = [
        F.struct(
            F.lit(c).alias("question"),
            F.count(c).alias("size"),
            F.avg(F.when(F.col(c) >= 0, F.col(c))).alias("avg_resp"),
        ).alias(c)
        for c in cols
    ]
    return df.groupBy(*keys).agg(*per_col).select(*keys, F.inline(F.array(*cols)))


def thickness(cells: DataFrame, geo: str, period: str, question: str) -> DataFrame:
    """Distinct question-periods, periods and questions with data per country."""
    pairs = cells.select(geo, period, question).distinct()
    return pairs.groupBy(geo).agg(
        F.count(F.lit(1)).alias("question_periods"),
        F.countDistinct(period).alias("periods"),
        F.countDistinct(question).alias("questions"),
    )


def question_coverage(sizes: DataFrame, by: Sequence[str], geo: str, min_n: int) -> DataFrame:
    """Countries with data per question (and source), from ``min_n`` countries on."""
    seen = sizes.where(F.col("size") != 0).select(*by, geo).distinct()
    return seen.groupBy(*by).agg(F.count(geo).alias("ctry_n")).where(F.col("ctry_n") >= min_n)


def region_obs(cells: DataFrame, unit: str, period: str, option: str = "option", yes: str = "yes") -> DataFrame:
    """Question cells with answers per region and period."""
    once = cells.drop(option, yes).distinct()
    return once.groupBy(unit, period).agg(F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("obs"))


def country_obs(cells: DataFrame, nat: DataFrame, unit: str, period: str) -> DataFrame:
    """0/1 flag per country and period from regional or national cells.

    The two tables are joined on the flag too, so a country-period whose flags
    differ appears twice.
    """

    def flag(df: DataFrame) -> DataFrame:
        total = df.groupBy(unit, period).agg(F.sum("size").alias("size"))
        return total.select(unit, period, F.when(F.col("size") > 0, 1).otherwise(0).alias("obs"))

    return full_join(flag(cells), flag(nat), [unit, period, "obs"])


def question_obs(cells: DataFrame, nat: DataFrame, region: str, country: str, period: str) -> DataFrame:
    """Cells with answers per question over regional and national tables."""

    def per_table(df: DataFrame, keys: list[str]) -> DataFrame:
        once = df.select("question", "size", period, *keys).distinct()
        return once.groupBy("question").agg(F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("obs"))

    both = union_all(per_table(cells, [region, country]), per_table(nat, [country]))
    return both.groupBy("question").agg(F.sum("obs").alias("obs"))


def total_responses(cells: DataFrame, nat: DataFrame, region: str, country: str, period: str) -> DataFrame:
    """Answers, counting a cell once rather than once per option."""

    def per_table(df: DataFrame, geo: str, label: str) -> DataFrame:
        once = df.select("question", F.col(geo).alias("geo"), "size", period).distinct()
        return once.agg(F.sum("size").alias("responses")).select(F.lit(label).alias("level"), "responses")

    parts = union_all(per_table(cells, region, "region"), per_table(nat, country, "nation"))
    return parts.agg(
        F.sum(F.when(F.col("level") == "region", F.col("responses"))).alias("regional"),
        F.sum("responses").alias("total"),
    )


def samples(cells: DataFrame, key: str) -> DataFrame:
    """Sum of ``size`` with every option counted, the sample measure of the quotient tables."""
    return cells.groupBy(key).agg(F.sum("size").alias("n"))


def geo_mean(col: str | Column) -> Column:
    """Geometric mean as an aggregate; logarithms avoid overflow."""
    c = F.col(col) if isinstance(col, str) else col
    return F.exp(F.avg(F.ln(F.when(c > 0, c))))


def n_thresholds(cells: DataFrame) -> DataFrame:
    return cells.groupBy("question").agg((F.max("option") - 1).alias("kmin1"))


def regional_cv(est: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Coefficient of variation of regional scores inside each country."""
    return est.groupBy(*by).agg(
        F.avg(score).alias("nat_regionmean"),
        F.stddev_samp(score).alias("nat_regionsd"),
        F.try_divide(F.stddev_samp(score), F.avg(score)).alias("nat_cv"),
    )


def correlation(x: str, y: str, use: str = "complete") -> Column:
    """Correlation aggregate, missing for a constant column.

    ``complete`` drops incomplete pairs; ``everything`` is missing as soon as one
    pair is incomplete. From sums of squares, as ``corr`` divides by zero on a
    constant column under ANSI rules.
    """
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    value = F.try_divide(F.regr_sxy(y, x), spread)
    if use == "everything":
        incomplete = F.max((F.col(x).isNull() | F.col(y).isNull()).cast("int"))
        return F.when(incomplete == 0, value)
    if use != "complete":
        raise ValueError(use)
    return value


def validation_corr(
    df: DataFrame, x: str, y: str, by: Sequence[str], geo: str, use: str = "everything", digits: int = 2
) -> DataFrame:
    """Correlation and number of countries per group with more than one country."""
    one = df.groupBy(*by).agg(correlation(x, y, use).alias("corr"))
    countries = df.select(*by, geo).distinct().groupBy(*by).agg(F.count(geo).alias("ncountries"))
    kept = countries.where(F.col("ncountries") > 1)
    joined = left_join(kept, one, list(by))
    return joined.withColumn("corr", F.bround("corr", digits))
