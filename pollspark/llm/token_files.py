"""Token ids in Simple-8b files: 64-bit words whose selector says how many ids share the word.

A file row is a block of whole documents: their ids and lengths, the block's place
in its file, and the coded ids. Blocks are coded in sub-blocks of ``SUB`` ids, each
starting on a word; the offsets of their first words allow a reader to decode any
sub-block alone and all of them at once with array operations. An id of more than
60 bits is an escape: its word holds an index into a list of raw values at the end.

Files are written and read by Spark (parquet rows with a binary payload), so they
lie wherever Spark can write, survive lost executors and never appear half written.

Cases: a null text is an empty one (its end id alone); an empty table gives files
without rows; repeated rows are kept, equal ids in the order of a hash of their texts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.llm.common import map_batches, table, texts
from pollspark.llm.tokens import encoder, vocabulary_path
from pollspark.session import shared_dir

#: Selector k packs WIDTHS[k][0] values of WIDTHS[k][1] bits; selector 0 is the escape.
WIDTHS = [(1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC = b"S8B1"
SUB = 128
#: Ids that close a block; a longer document makes a longer block.
BLOCK_IDS = 1 << 17
END_ID = 2
#: Chunks a worker remembers (some 200 bytes each); new ones take most of the time.
MEMO = 1_300_000

FILE = "shard int, block int, first_id long, n_ids long, doc_ids array<{id}>, n_tokens array<long>, payload binary"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.size == 0 or int(values.max()) < 1 << 53:
        return np.frexp(values.astype(np.float64))[1].astype(np.int8)
    high = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low).astype(np.int8)


def encode_words(values: np.ndarray) -> bytes:
    """Payload of a block: magic, counts, first word of each sub-block, words, escaped values."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    subs, wide = -(-n // SUB), SUB + 64  # spare zeros: a last word may look past its sub-block's end
    flat = np.zeros(subs * SUB, dtype=np.uint64)
    flat[:n] = values
    size = bit_lengths(flat)
    raw = np.flatnonzero(size > 60)
    escaped = flat[raw]
    flat[raw] = np.arange(len(raw), dtype=np.uint64)
    bits = np.zeros((subs, wide), dtype=np.int8)
    bits[:, :SUB] = size.reshape(subs, SUB)
    # Widest value in the next 1, 2, 4, ... places, then in any number of places.
    widest = {1: bits}
    for k in (2, 4, 8, 16, 32):
        half = widest[k // 2]
        widest[k] = half.copy()
        np.maximum(half[:, : -(k // 2)], half[:, k // 2 :], out=widest[k][:, : -(k // 2)])
    choice = np.zeros((subs, SUB), dtype=np.int8)
    for k in range(len(WIDTHS) - 1, 0, -1):  # the fullest selector that fits is set last
        count, width = WIDTHS[k]
        near = 1 << (count.bit_length() - 1)
        most = np.maximum(widest[near][:, :SUB], widest[near][:, count - near : count - near + SUB])
        choice[most <= width] = k
    step = np.asarray([c for c, _ in WIDTHS])[choice.ravel()]
    # Follow the words of all sub-blocks together.
    ends = np.minimum(SUB * np.arange(1, subs + 1), n)
    at, live, starts = SUB * np.arange(subs), np.arange(subs), []
    while len(live):
        here = at[live]
        starts.append(here)
        here = here + step[here]
        at[live] = here
        live = live[here < ends[live]]
    starts = np.sort(np.concatenate(starts)) if starts else np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(starts // SUB, minlength=subs))]).astype("<u4")
    used = choice.ravel()[starts]
    words = used.astype(np.uint64) << np.uint64(60)
    spare = np.zeros(subs * SUB + 64, dtype=np.uint64)
    spare[: subs * SUB] = flat
    room = SUB - starts % SUB
    for k, (count, width) in enumerate(WIDTHS):
        mine = np.flatnonzero(used == k)
        if len(mine):
            begin, left, word = starts[mine], room[mine], words[mine]
            for i in range(count):
                value = spare[begin + i] << np.uint64(i * width)
                word |= value if i == 0 else np.where(left > i, value, np.uint64(0))
            words[mine] = word
    head = MAGIC + struct.pack("<QQQ", n, len(words), len(escaped))
    return head + first.tobytes() + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()


def decode_words(payload: bytes) -> np.ndarray:
    """All values of a block, selector by selector."""
    if bytes(memoryview(payload)[:4]) != MAGIC:
        raise ValueError("not a block of this format")
    n, n_words, n_escaped = struct.unpack_from("<QQQ", payload, 4)
    subs = -(-n // SUB)
    first = np.frombuffer(payload, "<u4", subs + 1, 28).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, 28 + 4 * (subs + 1))
    escaped = np.frombuffer(payload, "<u8", n_escaped, 28 + 4 * (subs + 1) + 8 * n_words)
    used = (words >> np.uint64(60)).astype(np.int64)
    counts = np.asarray([c for c, _ in WIDTHS] + [0])[used]
    ends = np.cumsum(counts)
    begin = np.concatenate([[0], ends])
    sub = np.repeat(np.arange(subs), np.diff(first))
    place = begin[:-1] - begin[first[:-1]][sub] if n_words else begin[:0]  # within the sub-block
    out = np.zeros((subs, SUB + 64), dtype=np.uint64)
    for k, (count, width) in enumerate(WIDTHS):
        mine = np.flatnonzero(used == k)
        mask = np.uint64((1 << width) - 1)
        for i in range(count):
            value = (words[mine] >> np.uint64(i * width)) & mask
            out[sub[mine], place[mine] + i] = escaped[value.astype(np.int64)] if k == 0 else value
    return out[:, :SUB].reshape(-1)[:n]


def decode_sub(payload: bytes, index: int) -> np.ndarray:
    """The values of one sub-block alone, by its word offset."""
    n, n_words, n_escaped = struct.unpack_from("<QQQ", payload, 4)
    subs = -(-n // SUB)
    a, b = struct.unpack_from("<II", payload, 28 + 4 * index)
    base = 28 + 4 * (subs + 1)
    size = min(SUB, n - SUB * index)
    head = MAGIC + struct.pack("<QQQ", size, b - a, n_escaped) + struct.pack("<II", 0, b - a)
    return decode_words(head + payload[base + 8 * a : base + 8 * b] + payload[base + 8 * n_words :])


def write_token_files(
    docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Ids of every text and ``end_id``, in ascending id order: shard by shard, block by block.

    One shuffle, a range partitioning by id. A task holds one block at a time.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        keys, counts, held, size = [], [], [], 0

        def close() -> dict:
            values = np.frombuffer(b"".join(held), dtype="<u4")
            return {"shard": [shard], "block": [block], "first": [first], "n": [size], "ids": [list(keys)], "counts": [list(counts)], "payload": [encode_words(values)]}

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), encoder(path, MEMO).encode(batch.column(1).to_pylist()), strict=True):
                keys.append(key)
                counts.append(len(raw) // 4 + 1)
                held += [raw, end]
                size += counts[-1]
                if size >= BLOCK_IDS:
                    yield close()
                    block, first = block + 1, first + size
                    keys, counts, held, size = [], [], [], 0
        if keys:
            yield close()

    # The hash lets rows of one id, however many, be dealt to several tasks.
    order = [F.col(id_col), F.xxhash64(text_col)]
    ordered = texts(docs, text_col, id_col).repartitionByRange(*order).sortWithinPartitions(*order, text_col)
    coded = map_batches(ordered, code, FILE.format(id=kind))
    coded.write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])`` of every document in the files.

    ``start`` counts the ids of all documents before: the block's place in its shard
    plus the shards before. Only the shard totals, one row a file, pass a window.
    """
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            shards, firsts = (batch.column(i).to_pylist() for i in (0, 1))
            for i in range(batch.num_rows):
                doc_ids, lengths = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
                ids = decode_words(batch.column(4)[i].as_buffer()).astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                parts = [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = {
                    "shard": [shards[i]] * len(parts), "id": doc_ids, "start": begins + firsts[i],
                    "n": lengths, "crc": [zlib.crc32(p) for p in parts],
                }
                yield out | ({"ids": [p.astype("<i4") for p in parts]} if with_ids else {})

    extra = ", ids array<int>" if with_ids else ""
    read = map_batches(
        blocks.select("shard", "first_id", "doc_ids", "n_tokens", "payload"), split,
        f"__shard int, `{id_col}` {kind}, start long, n_tokens long, ids_crc32 long{extra}",
    )
    before = Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(F.col("shard").alias("__shard")).agg(F.sum("n_ids").alias("__n"))
    shift = totals.select("__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        read.join(shift, "__shard")  # one row a file, which Spark broadcasts while it is small
        .withColumn("start", F.col("start") + F.col("__before"))
        .drop("__shard", "__before")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
