"""What the operators share: reading the tables, Arrow batches in and out, small run helpers.

Inputs are DataFrames with an id column and a text column. Operators read only the
columns they are told to, so further columns of any name are ignored or passed
through unchanged. A null text counts as empty unless an operator says otherwise;
null and repeated ids are allowed, every row is treated on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handled at a time inside a task, whatever the size of the Arrow batches.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The columns ``keep`` and the text, where null is empty."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``docs`` with ``__key``: the id and a hash of the text and ``more``, so rows of one id are told apart by content."""
    return docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col, *more).alias("hash")))


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of ``keyed`` docs whose key is not among ``removed``'s, which is shuffled or sent as its size asks."""
    gone = removed.select(F.col("__key.id").alias("__id"), F.col("__key.hash").alias("__hash")).distinct()
    same = F.col("__key.id").eqNullSafe(F.col("__id")) & (F.col("__key.hash") == F.col("__hash"))
    return docs.join(gone, same, "left_anti").drop("__key")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(
    df: DataFrame,
    step: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
    schema: str | StructType,
    rows: int = SLICE,
) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of columns in the order of ``schema``.

    Input batches come in slices of at most ``rows`` rows, so that a task holds a
    bounded number of texts at a time.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for columns in step(slices(batches, rows)):
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in zip(arrow, columns.values(), strict=True)],
                schema=arrow,
            )

    return df.mapInArrow(run, kind)


def free(name: str, taken: list[str]) -> str:
    """``name``, with an underscore for each column of that name that the caller already has."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def as_one(df: DataFrame, **more: str) -> DataFrame:
    """All columns as the struct ``__row``, and the named ones of ``more`` beside it, so that no other name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    return df.select(whole, *[F.col(f"`{c}`").alias(name) for name, c in more.items()])


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of the UTF-8 bytes of the column ``text``, bit by bit."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    bits = f"list_transform(range(octet_length(encode({text}))), lambda i: list_transform(range(8), lambda j: ({byte} >> j) & 1))"
    step = "lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1))"
    return f"xor(list_reduce([4294967295::BIGINT] || flatten({bits}), {step}), 4294967295)"


__all__ = ["SLICE", "as_one", "crc32_sql", "free", "keyed", "map_batches", "slices", "table", "texts", "without"]
