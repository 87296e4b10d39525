"""Exact top-k search: every candidate of every query, scored term at a time.

A vector is a sparse row of whole weights, its non-zero components. Candidates are
numbered in the order of their ids and cut into blocks of consecutive numbers; a block
is kept as an inverted index, one postings row (places, weights) per term. The stated
query set is cut into blocks too, and each pair of a query block and a candidate block
is one task's work: every query scatters its weights times the postings of its terms
into a dense score array over the block, a partition picks the block's best, and the
best of all blocks are merged per query. Nothing is skipped or estimated. Blocks hold a
bounded number of weights, so a task's memory does not depend on the table, and as
numbers are dealt out by position no vector or id, however common, makes a block large.

Cases: a null vector, or one with a null or non-finite component, takes no part, neither
as query nor as candidate; a null id is a candidate, before all others where scores tie,
but no query of ``op11``; a query's own row is left out by its number, so further rows of
its id are candidates like others; vectors of zeros and empty vectors score 0 with
everything; vectors of different lengths are compared over the components both have; a
query with fewer than ``k`` candidates has as many results; an empty table or query set
gives no rows. Scores are exact as long as they fit 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pollspark.llm.common import table
from pollspark.operators.ranking import row_numbers
from pollspark.session import materialise

K = 5
SCALE = 256
EVERY = 50
#: Weights of a candidate block; its postings take twelve bytes each.
BLOCK_WEIGHTS = 1 << 21
#: Weights of a query block.
QUERY_WEIGHTS = 1 << 20
#: Scores held at a time: some queries against all candidates of a block.
SCORES = 1 << 21
#: Term of the row that carries a block's ids.
HEAD = -1

NONE = np.iinfo(np.int64).min


def sparse_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, terms, weights)``: the non-zero ones of floor(``scale`` * component), for vectors that take part."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.where(x.isNotNull() & ~bad).select(
        F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("long")).alias("all")
    )
    places = F.transform("all", lambda w, i: F.when(w != 0, i))
    return rows.select(
        "id", F.array_compact(places).alias("terms"), F.filter("all", lambda w: w != 0).alias("weights")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their number ``place`` from 1 in the order of ids, written once."""
    # The second key tells rows of one id apart, so that any number of them can be spread.
    keyed = rows.withColumn("__row", F.monotonically_increasing_id())
    return materialise(row_numbers(keyed, [F.col("id").asc_nulls_first(), F.col("__row")], "place").drop("__row"))


def inverted(rows: DataFrame, size: int) -> DataFrame:
    """``(block, term, places, weights, ids)``: postings of blocks of ``size`` consecutive numbers.

    ``places`` count from 0 inside the block; the row of term ``HEAD`` has the block's ids by place.
    """
    kind = rows.schema["id"].dataType

    def index(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("place").combine_chunks()
        lists = part.column("terms").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        terms = lists.flatten().to_numpy(zero_copy_only=False)
        weights = part.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        owners = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        order = np.argsort(terms, kind="stable")
        kinds, starts = np.unique(terms[order], return_index=True)
        offsets = np.concatenate([[0, 0], starts[1:], [len(terms)]] if len(kinds) else [[0, 0]]).astype(np.int32)
        ids = part.column("id").combine_chunks()
        n = len(kinds) + 1
        return pa.table({
            "block": pa.array([key[0].as_py()] * n, pa.int64()),
            "term": pa.array(np.concatenate([[HEAD], kinds]).astype(np.int32)),
            "places": pa.ListArray.from_arrays(offsets, owners[order]),
            "weights": pa.ListArray.from_arrays(offsets, weights[order]),
            "ids": pa.ListArray.from_arrays(np.array([0] + [len(ids)] * n, dtype=np.int32), ids),
        })

    schema = f"block long, term int, places array<int>, weights array<long>, ids array<{kind.simpleString()}>"
    dealt = rows.select(F.expr(f"(place - 1) div {size}").alias("block"), "place", "id", "terms", "weights")
    return dealt.groupBy("block").applyInArrow(index, schema)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, best first, ties to the smaller place; own rows are ``NONE``."""
    n = len(scores)
    if n > k:
        least = np.partition(scores, n - k)[n - k]
        above = np.flatnonzero(scores > least)
        chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        chosen = np.arange(n)
    chosen = chosen[scores[chosen] != NONE]
    return chosen[np.lexsort((chosen, -scores[chosen]))]


def block_best(postings: dict, n: int, queries: list, first: int, k: int) -> tuple[list, list, list]:
    """``(query, place, score)`` of the best ``k`` of a block's ``n`` candidates for each query.

    ``queries``: (number, terms, weights); ``first`` is the number of the block's first candidate.
    """
    which, places, values = [], [], []
    held = max(1, SCORES // max(n, 1))
    for start in range(0, len(queries), held):
        some = queries[start : start + held]
        scores = np.zeros((len(some), n), dtype=np.int64)
        for row, (number, terms, weights) in zip(scores, some, strict=True):
            for term, weight in zip(terms, weights, strict=True):
                if term in postings:
                    at, of = postings[term]
                    if len(at) == n:  # every candidate has the term
                        row += weight * of
                    else:
                        row[at] += weight * of
            if first <= number < first + n:
                row[number - first] = NONE
        for i, row in enumerate(scores):
            best = _best(row, k)
            which += [start + i] * len(best)
            places.append(best)
            values.append(row[best])
    return which, places, values


def search(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query the ``k`` best of all other ``rows`` by inner product.

    Both are ``numbered`` sparse rows, the queries some of the rows; ties go to the smaller number.
    """
    spark = rows.sparkSession
    weights = F.coalesce(F.sum(F.size("terms")), F.lit(0))
    total, heavy = rows.agg(F.count(F.lit(1)), weights).first()
    asked, asked_heavy = queries.agg(F.count(F.lit(1)), weights).first()
    spread = math.ceil(total / spark.sparkContext.defaultParallelism)
    size = max(1, min(spread, BLOCK_WEIGHTS * max(total, 1) // max(heavy, total, 1)))
    blocks, groups = math.ceil(total / size), max(1, math.ceil(max(asked_heavy, asked) / QUERY_WEIGHTS))
    kind = rows.schema["id"].dataType

    def score(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        postings, ids = {}, None
        for batch in index.to_batches():
            places, weights = batch.column("places"), batch.column("weights")
            for i, term in enumerate(batch.column("term").to_pylist()):
                if term == HEAD:
                    ids = batch.column("ids")[i].values
                else:
                    postings[term] = (places[i].values.to_numpy(), weights[i].values.to_numpy())
        some = list(zip(*(asked.column(c).to_pylist() for c in ("place", "terms", "weights")), strict=True))
        first = key[0].as_py() * size + 1
        which, places, values = block_best(postings, len(ids), some, first, k)
        at = np.concatenate([np.zeros(0, np.int64), *places])
        which = pa.array(which, pa.int64())
        return pa.table({
            "query": asked.column("place").take(which), "query_id": asked.column("id").take(which),
            "place": pa.array(at + first), "id": ids.take(pa.array(at)),
            "score": pa.array(np.concatenate([np.zeros(0, np.int64), *values])),
        })

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    if not blocks:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, id {kind.simpleString()}, score long")
    index = materialise(inverted(rows, size)).select("*", every(groups).alias("group"))
    dealt = queries.select("*", F.pmod(F.xxhash64("place"), F.lit(groups)).alias("group"), every(blocks).alias("block"))
    cells = index.groupBy("block", "group").cogroup(dealt.groupBy("block", "group"))
    schema = f"query long, query_id {kind.simpleString()}, place long, id {kind.simpleString()}, score long"
    found = materialise(cells.applyInArrow(_where_both(score, schema), schema))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "place")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _where_both(score, schema: str):
    """``score`` for cells that have candidates and queries, nothing for others."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def step(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        return score(key, index, asked) if index.num_rows and asked.num_rows else empty

    return step


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    rows = numbered(sparse_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = search(rows.where(F.col("id") % EVERY == 0), rows)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST) AS place, vec_id,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id, c.place AS other, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.place <> c.place
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, other)::INT AS "rank", vec_id, score
    FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""
