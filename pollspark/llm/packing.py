"""Best-fit packing: the plan works on counts of lengths, documents then take planned slots.

``pack`` never looks at a single row to place it. One aggregation counts the rows
of each length; the plan (``best_fit``) fits lengths from the longest down, each
into the fullest sequences that still hold it, many sequences in one step; rows get
a rank within their length and join the plan on that rank.

Cases: a null text is an empty one (a single end id); an empty table gives no rows;
repeated rows and ids are packed row by row; lengths below 1 or above the capacity
are refused, since ``pieces`` cuts to the capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.llm.common import as_one, free, map_batches, table, texts
from pollspark.llm.tokens import encoder, vocabulary_path
from pollspark.session import materialise

CAPACITY = 2048
END_ID = 0
#: Rows of one length that are ranked together.
BLOCK = 20_000
#: Plan rows that may be broadcast (some 50 bytes each); a larger plan is joined by shuffle.
BROADCAST_RUNS = 200_000

RUNS = "length int, first_rank long, last_rank long, per_sequence int, first_sequence long, first_offset int"


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each text's ids and the end id, cut to ``capacity``.

    All pieces but the first are full. Task state is the encoder's bounded memo.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = {k: [] for k in ("id", "piece", "start", "length", "crc", *(["ids"] if with_ids else []))}
            for key, raw in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                ends = range(n - (n - 1) // capacity * capacity, n + 1, capacity)
                start = 0
                for piece, stop in enumerate(ends):
                    part = raw[4 * start : 4 * stop]
                    out["id"].append(key)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(stop - start)
                    out["crc"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<i4"))
                    start = stop
            yield out

    ids = ", ids array<int>" if with_ids else ""
    return map_batches(
        texts(docs, text_col, id_col), cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long{ids}"
    )


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Plan rows of ``RUNS`` and the number of sequences.

    ``free[r]`` lists ranges of sequences with r free places, all filled alike. The
    items of one length go to the range with the least sufficient room first; a
    range takes as many per sequence as fit, which is what placing one item after
    the other into the fullest sequence does. Memory: at most two new ranges for a
    length, whatever the number of items.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, n: int, room: int, left: int, rank: int) -> tuple[int, int]:
            """Put items into ``n`` sequences from ``first`` with ``room`` places; what is left, next rank."""
            each = room // length
            whole = min(n, left // each)
            for count, per, at in ((whole, each, first), (1 if whole < n and left % each else 0, left % each, first + whole)):
                if count:
                    runs.append((length, rank, rank + count * per - 1, per, at, capacity - room))
                    free[room - per * length].append((at, count))
                    rank += count * per
                    left -= count * per
                    n -= count
                    first += count
                    if left == 0:
                        break
            if n:
                free[room].append((first, n))
            return left, rank

        for room in range(length, capacity):
            if left and free[room]:
                ranges, free[room] = free[room], []
                for i, (first, n) in enumerate(ranges):
                    if not left:
                        free[room].extend(ranges[i:])
                        break
                    left, rank = fill(first, n, room, left, rank)
        if left:
            n = -(-left // (capacity // length))
            fill(sequences, n, capacity, left, rank)
            sequences += n
    return runs, sequences


def ranked(rows: DataFrame, by: str, order: Sequence[Column], most: int, block: int = BLOCK) -> DataFrame:
    """Column ``__rank``: place of a row among the rows of its ``by``, from 0.

    Rows of one value are dealt to blocks by a hash of ``order``, ranked within the
    block and shifted by the counts of the blocks before, so a value that holds
    most rows is spread over many tasks. Equal rows get different ranks.
    """
    blocks = max(1, -(-most // block))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        dealt.groupBy(by, "__block").agg(F.count(F.lit(1)).alias("__n"))
        .select(by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    within = Window.partitionBy(by, "__block").orderBy(*order)
    return (
        dealt.join(shift, [by, "__block"])
        .withColumn("__rank", F.col("__shift") + F.row_number().over(within) - 1)
        .drop("__shift", "__block")
    )


def pack(rows: DataFrame, order: Sequence[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: a place in a sequence of at most ``capacity``.

    ``rows`` should be cheap to read several times (``materialise`` it). On the
    driver: one count per length, and the plan made from them; neither grows with
    the number of rows. Columns of ``rows`` stay, whatever their names; where one is
    called like ours, ours gets an underscore more.
    """
    spark = rows.sparkSession
    names = [free(n, rows.columns) for n in ("sequence_id", "offset")]
    keys = {f"__order{i}": c for i, c in enumerate(order)}
    rows = as_one(rows, __size=length, **keys)
    counts = {r[0]: r[1] for r in rows.groupBy("__size").agg(F.count(F.lit(1))).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    runs, _ = best_fit(counts, capacity)
    plan = spark.createDataFrame(runs, RUNS).withColumnRenamed("length", "__length")
    if len(runs) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    placed = ranked(rows, "__size", [F.col(c) for c in keys], max(counts.values(), default=0))
    inside = (F.col("__size") == F.col("__length")) & F.col("__rank").between(F.col("first_rank"), F.col("last_rank"))
    step = F.col("__rank") - F.col("first_rank")
    return placed.join(plan, inside).select(
        "__row.*",
        (F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).cast("long").alias(names[0]),
        (F.col("first_offset") + F.pmod(step, F.col("per_sequence")) * F.col("__size")).cast("long").alias(names[1]),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves, from ``pack`` over ``pieces(with_ids=True)``.

    A group holds at most ``capacity`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places; ids are left out (``pieces(with_ids=True)`` has them)."""
    cut = materialise(pieces(docs, capacity, end_id, path))
    return pack(cut, ["doc_id", "piece", "ids_crc32"], capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packed_documents(table(spark, sf_dir, "documents"))
