"""Survey-shaped tables derived from the test tables (bindings in FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.functions.columns import biennium, paste
from pollspark.operators.cells import ordinal_counts, region_weights
from pollspark.operators.ranking import global_position
from pollspark.operators.relate import inner_join, left_join, union_all
from pollspark.operators.scores import poststratify
from pollspark.operators.shape import encode
from pollspark.session import materialise
from pollspark.sources.tables import load_table

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
PERIODS = ("2002-03", "2004-05", "2006-07", "2008-09")
QUESTIONS = ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O")
QUESTION_COLS = ("q_a_f", "q_a_o", "q_n_f", "q_n_o", "q_r_f", "q_r_o")
EMBEDDED = tuple(f"e{i}" for i in range(1, 65))
FINAL = "2008-09"


#: Normal quantile of a 90 % interval.
Z90 = 1.6448536269514722


def interval(df: DataFrame, sd: str) -> DataFrame:
    """``q5`` and ``q95`` of normal scores ``mean`` with deviation ``sd``."""
    return df.withColumn("q5", F.col("mean") - Z90 * F.col(sd)).withColumn("q95", F.col("mean") + Z90 * F.col(sd))


class Survey:
    """Plans over one data folder. Tables that several plans read are written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.sf_dir, f"{name}.parquet", schema=SCHEMAS.get(name))

    @cached_property
    def places(self) -> DataFrame:
        """Customers with nation and market segment."""
        customer, nation, region = self.table("customer"), self.table("nation"), self.table("region")
        joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
            region, nation.n_regionkey == region.r_regionkey
        )
        return joined.select(
            "c_custkey",
            F.col("r_name").alias("continent_name"),
            F.col("n_name").alias("iso_3166"),
            F.concat_ws(":", "n_name", "c_mktsegment").alias("mergekey"),
        )

    @cached_property
    def placed_orders(self) -> DataFrame:
        """Orders with their place: the small join first, so that line items are shuffled once."""
        orders = self.table("orders")
        joined = orders.join(self.places, orders.o_custkey == F.col("c_custkey"))
        return joined.select("o_orderkey", "o_orderpriority", "o_orderstatus", "continent_name", "iso_3166", "mergekey")

    @cached_property
    def answers(self) -> DataFrame:
        """One answer per line item."""
        lineitem, orders = self.table("lineitem"), self.placed_orders
        located = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        rating = F.ceil(F.col("l_quantity") / 10)
        year = (F.year("l_shipdate") + 7).cast("int")
        return located.select(
            "l_orderkey",
            "l_linenumber",
            "continent_name",
            "iso_3166",
            "mergekey",
            F.col("o_orderpriority").alias("source2"),
            F.col("o_orderstatus").alias("orderstatus"),
            year.alias("year"),
            F.concat_ws("_", "l_returnflag", "l_linestatus").alias("question"),
            F.when(F.col("l_returnflag") == "N", F.least(rating, F.lit(3))).otherwise(rating).cast("int").alias("option"),
            biennium(year).alias("year2"),
            ((year - year % 2 - 2000) / 2).cast("int").alias("year_int"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        regional = self.answers.where(F.col("orderstatus") != "P")
        return ordinal_counts(regional, ["continent_name", "iso_3166", "mergekey"], ["year2", "year_int"])

    @cached_property
    def both_cells(self) -> DataFrame:
        """Regional and national cells as one saved table, counted in one pass over the answers.

        National answers have no region key.
        """
        national = F.col("orderstatus") == "P"
        levels = self.answers.where(F.col("orderstatus").isNotNull()).withColumns(
            {"national": national, "mergekey": F.when(~national, F.col("mergekey"))}
        )
        geo = ["national", "continent_name", "iso_3166", "mergekey"]
        return materialise(ordinal_counts(levels, geo, ["year2", "year_int"]))

    @cached_property
    def stored_cells(self) -> DataFrame:
        """The regional cells of the saved table, for queries that read them more than once."""
        return self.both_cells.where(~F.col("national")).drop("national")

    @cached_property
    def stored_nat(self) -> DataFrame:
        return self.both_cells.where("national").drop("national", "mergekey")

    @cached_property
    def population(self) -> DataFrame:
        return self.places.groupBy("iso_3166", "mergekey").agg(F.count(F.lit(1)).alias("region_pop"))

    @cached_property
    def weights(self) -> DataFrame:
        return region_weights(self.population, "iso_3166", "mergekey", "region_pop")

    @cached_property
    def est_reg(self) -> DataFrame:
        """Direct score: count-weighted mean option on a 0-1 scale."""
        steps = F.when(F.col("question").startswith("N"), 2.0).otherwise(4.0)
        return self.stored_cells.groupBy("iso_3166", "mergekey", "year2", "year_int").agg(
            (F.sum(F.col("yes") * (F.col("option") - 1) / steps) / F.sum("yes")).alias("mean"),
            F.sum("yes").alias("n"),
        )

    @cached_property
    def spread_reg(self) -> DataFrame:
        """Direct scores with the deviation of a mean of that many answers and the interval it gives."""
        steps = F.when(F.col("question").startswith("N"), 2.0).otherwise(4.0)
        value, n = (F.col("option") - 1) / steps, F.sum("yes")
        sums = self.stored_cells.groupBy("iso_3166", "mergekey", "year2", "year_int").agg(
            (F.sum(F.col("yes") * value) / n).alias("mean"), (F.sum(F.col("yes") * value * value) / n).alias("square"), n.alias("n")
        )
        sd = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)) / F.col("n"))
        return interval(sums.withColumn("sd", sd).drop("square", "n"), "sd")

    @cached_property
    def spread_nat(self) -> DataFrame:
        """Poststratified scores with the deviation of their weighted sum and its interval."""
        joined = inner_join(self.spread_reg, self.weights.select("mergekey", "wt"), ["mergekey"])
        wt, total = F.col("wt"), F.sum("wt")
        sums = joined.groupBy("iso_3166", "year2", "year_int").agg(
            (F.sum(F.col("mean") * wt) / total).alias("mean"), (F.sqrt(F.sum((wt * F.col("sd")) * (wt * F.col("sd")))) / total).alias("sd")
        )
        return interval(sums, "sd")

    @cached_property
    def est_nat(self) -> DataFrame:
        return poststratify(self.est_reg, self.weights, "mean", ("year2", "year_int"), renormalise=True, name="mean")

    @cached_property
    def continents(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_name").alias("iso_3166"), F.col("r_name").alias("continent_name")
        )

    @cached_property
    def draw_values(self) -> DataFrame:
        """Draws without iteration number, from the event stream table."""
        return self.table("events").select(
            F.concat(
                F.lit("region_alpha["),
                (F.col("user_id") % 3 + 1).cast("string"),
                F.lit(","),
                (F.hour("ts") % 2 + 1).cast("string"),
                F.lit("]"),
            ).alias("variable"),
            (F.col("event_id") % 4 + 1).alias("chain"),
            "event_id",
            "value",
        )

    @cached_property
    def draws(self) -> DataFrame:
        """One row per variable, chain and iteration; events are numbered by id.

        There are only 24 chains, so they are numbered without a window over a chain.
        """
        placed = global_position(self.draw_values, [F.col("event_id")], by=["variable", "chain"], name="iteration")
        return placed.withColumn("iteration", F.col("iteration") + 1).drop("event_id")

    @cached_property
    def exposure(self) -> DataFrame:
        nation = self.table("nation")
        mean = self.table("supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("exposure"))
        joined = left_join(nation, mean, [("n_nationkey", "s_nationkey")])
        return joined.select(
            F.col("n_name").alias("iso_3166"),
            F.when(F.col("n_nationkey") % 10 != 3, F.col("exposure")).alias("exposure"),
        )

    @cached_property
    def energy(self) -> DataFrame:
        """Line items of one part type with their place: the energy sector of the fixture."""
        lineitem, part, orders = self.table("lineitem"), self.table("part"), self.placed_orders
        sector = lineitem.join(part.where(F.col("p_type") == "ECONOMY"), lineitem.l_partkey == F.col("p_partkey"))
        return sector.join(orders, sector.l_orderkey == orders.o_orderkey)

    @cached_property
    def emissions(self) -> DataFrame:
        return self.energy.groupBy("iso_3166", "mergekey").agg(F.sum("l_extendedprice").alias("emissions"))

    @cached_property
    def wide(self) -> DataFrame:
        """Microdata shape: one row per order, a column per question, -1 for do not know."""
        code = F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("option"))
        asked = [
            F.max(F.when(F.col("question") == q, code)).alias(c) for q, c in zip(QUESTIONS, QUESTION_COLS, strict=True)
        ]
        # The first period as a number: text aggregates would sort the answers.
        one = self.answers.groupBy("l_orderkey", "iso_3166", "mergekey", "source2").agg(F.min("year").alias("year"), *asked)
        return one.select("l_orderkey", "iso_3166", "mergekey", "source2", biennium("year").alias("year2"), *QUESTION_COLS)

    @cached_property
    def item_gamma(self) -> DataFrame:
        return self.stored_cells.groupBy("question").agg(
            (F.avg("option") / 2.5).alias("gamma_raw"), (F.max("option") - 1).alias("kmin1")
        )

    @cached_property
    def item_beta(self) -> DataFrame:
        """Four raw cutpoints per question, from one aggregate row per question."""
        shares = [F.avg(F.when(F.col("option") <= k, 1.0).otherwise(0.0)) for k in range(1, 5)]
        rows = F.array(*[F.struct(F.lit(k).alias("k"), (k + s).alias("beta_raw")) for k, s in enumerate(shares, 1)])
        return self.stored_cells.groupBy("question").agg(rows.alias("rows")).select("question", F.inline("rows"))

    @cached_property
    def drifting(self) -> DataFrame:
        """Regional scores whose last observation counts are zeroed for some regions."""
        size = F.length("mergekey") % 6
        gone = ((F.col("year2") == FINAL) & size.isin(0, 2)) | ((F.col("year2") == "2006-07") & (size == 0))
        return self.est_reg.withColumn("obs", F.when(gone, 0).otherwise(F.col("n"))).drop("n")

    @cached_property
    def embedded(self) -> DataFrame:
        """The entries of the embeddings as columns."""
        return self.table("embeddings").select(
            "vec_id",
            F.col("label").alias("source"),
            *[F.element_at("embedding", i).cast("double").alias(c) for i, c in enumerate(EMBEDDED, 1)],
        )

    @cached_property
    def shapes(self) -> DataFrame:
        """Attribute table of all nation and segment pairs seen, and of nations without scores."""
        seen = self.places.select("iso_3166", "mergekey", "continent_name").distinct()
        nations = self.continents.select(
            "iso_3166", paste(":", "iso_3166", F.lit("NONE")).alias("mergekey"), "continent_name"
        )
        # Two countries without estimates and without a continent.
        invented = nations.where(F.col("iso_3166").isin("NATION_0", "NATION_1")).select(
            F.regexp_replace("iso_3166", "NATION", "LAND").alias("iso_3166"),
            F.regexp_replace("mergekey", "NATION", "LAND").alias("mergekey"),
            F.lit(None).cast("string").alias("continent_name"),
        )
        return seen.unionByName(invented)

    @cached_property
    def outside(self) -> DataFrame:
        """Outside series: order totals by place and year."""
        orders = self.table("orders")
        return orders.join(self.places, orders.o_custkey == F.col("c_custkey")).select(
            "iso_3166",
            "mergekey",
            (F.year("o_orderdate") + 7).cast("int").alias("year"),
            F.col("o_totalprice").alias("concern"),
        )

    @cached_property
    def coded_cells(self) -> DataFrame:
        """Cells with integer codes for region, country and question."""
        return left_join(left_join(left_join(self.stored_cells, self.region_codes, "mergekey"), self.country_codes, "iso_3166"),
                         self.question_codes, "question")

    @cached_property
    def coded_nat(self) -> DataFrame:
        return left_join(left_join(self.stored_nat, self.country_codes, "iso_3166"), self.question_codes, "question")

    @cached_property
    def region_codes(self) -> DataFrame:
        return encode(self.stored_cells.select("mergekey").distinct(), "mergekey", "regioncode_int")

    @cached_property
    def country_codes(self) -> DataFrame:
        both = self.stored_cells.select("iso_3166").unionByName(self.stored_nat.select("iso_3166")).distinct()
        return encode(both, "iso_3166", "iso_3166_int")

    @cached_property
    def question_codes(self) -> DataFrame:
        both = self.stored_cells.select("question").unionByName(self.stored_nat.select("question")).distinct()
        return encode(both, "question", "question_int")

    @cached_property
    def summary(self) -> DataFrame:
        """Parameter summary: one row per indexed variable with mean, q5 and q95."""

        def named(df: DataFrame, parameter: str, index: list[str], value: str) -> DataFrame:
            inside = F.concat_ws(",", *[F.col(c).cast("string") for c in index])
            variable = F.concat(F.lit(parameter + "["), inside, F.lit("]"))
            return df.select(variable.alias("variable"), F.col(value).cast("double").alias("mean"))

        region = inner_join(self.est_reg, self.region_codes, ["mergekey"])
        country = inner_join(self.est_nat, self.country_codes, ["iso_3166"])
        gamma = inner_join(self.item_gamma, self.question_codes, ["question"])
        beta = inner_join(self.item_beta, self.question_codes, ["question"])
        rows = union_all(
            named(region, "region_alpha", ["regioncode_int", "year_int"], "mean"),
            named(country, "country_poststrat", ["iso_3166_int", "year_int"], "mean"),
            named(gamma, "gamma", ["question_int"], "gamma_raw"),
            named(beta, "beta", ["question_int", "k"], "beta_raw"),
        )
        bands = rows.withColumn("q5", F.col("mean") - 0.1).withColumn("q95", F.col("mean") + 0.1)
        return materialise(bands)
