"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's word
shingles. Equal fingerprints are one entry from then on. Each bit is dealt a
non-zero vector of ``radius + 1`` bits; table v keeps the bits whose vector has an
odd product with v. For any ``radius`` differing bits some v is orthogonal to all
of their vectors, so in that table the pair's kept bits agree: every pair within the
radius shares a bucket in one of the ``2 ** (radius + 1) - 1`` tables.

Buckets are compared inside tasks and give one link per member at most (to the
smallest member it is connected with), never all pairs. A bucket with more than
``BUCKET`` fingerprints is split by a second family of tables, which covers every
pair again, and so on; each family halves the bits in which members can differ.

Cases: null, empty and white texts have fingerprint zero and are linked like others;
a text with fewer words than a shingle is one shingle; repeated rows and ids are
rows of their own with the same component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm.common import keyed, map_batches, table, texts, without
from pollspark.llm.graph import components
from pollspark.session import materialise

WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a bucket that a task compares; they take half a megabyte.
BUCKET = 1 << 16
#: Families after which a bucket is compared whatever its size. Members of a bucket differ in some 30
#: bits after the first family and in some 15 after the second, so a third is hardly ever needed.
FAMILIES = 6
#: Shingles counted at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    begins = np.concatenate([[0], ends])[:n].tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        hashes = [digest(line[a:b], seed) for a, b in zip(begins[i : i + CHUNK], stops[i : i + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield {"id": batch.column(0), "fp": fp.view(np.int64)}

    return map_batches(texts(docs, text_col, id_col), step, f"`{id_col}` {kind}, fp long")


def covering_masks(radius: int, family: int, bits: int = 64) -> list[int]:
    """The bits that each table of a family keeps, as unsigned masks."""
    order = np.random.default_rng([radius, family]).permutation(bits)
    tables = 2 ** (radius + 1) - 1
    vector = {int(bit): 1 + i % tables for i, bit in enumerate(order)}
    return [sum(1 << bit for bit, m in vector.items() if (m & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _reach(fp: np.ndarray, radius: int) -> np.ndarray:
    """Position of the smallest member connected with each member of one bucket.

    Breadth first; a member is compared with those not reached yet, so a dense
    bucket takes few comparisons and any bucket memory in proportion to its size.
    """
    label = np.arange(len(fp))
    left = np.arange(len(fp))
    while len(left):
        start, left = left[0], left[1:]
        queue = [start]
        while queue and len(left):
            close = np.bitwise_count((fp[left] ^ fp[queue.pop()]).view(np.uint64)) <= radius
            if close.any():
                reached, left = left[close], left[~close]
                label[reached] = start
                queue.extend(reached.tolist())
    return label


def star_links(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest connected member) inside buckets; rows come sorted by bucket and fingerprint."""
    n = len(fp)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [n]]))
    label = np.arange(n)
    pairs = starts[sizes == 2]  # by far the most buckets with links
    close = pairs[np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= radius]
    label[close + 1] = close
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        label[start : start + size] = start + _reach(fp[start : start + size], radius)
    linked = label != np.arange(n)
    return fp[linked], fp[label[linked]]


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (``u``, ``v``) over distinct fingerprints ``fp`` that connect all pairs within ``radius``."""

    def compare(whole: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held_b, held_f, big = np.zeros(0, np.int64), np.zeros(0, np.int64), None

            def split(b: np.ndarray, f: np.ndarray, final: bool) -> dict | None:
                """Links of complete buckets, rows of too large ones; keeps the last bucket unless final."""
                nonlocal held_b, held_f, big
                large = np.zeros(len(b), dtype=bool)
                starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
                sizes = np.diff(np.concatenate([starts, [len(b)]]))
                if not whole:
                    large = np.repeat((sizes > bucket) | (b[starts] == big if big is not None else False), sizes)
                tail = len(b) if final or not len(b) else int(starts[-1])
                if tail < len(b) and large[-1]:
                    big, tail = int(b[-1]), len(b)
                held_b, held_f = b[tail:], f[tail:]
                keep = ~large[:tail]
                u, v = star_links(b[:tail][keep], f[:tail][keep], radius)
                over_b, over_f = b[:tail][large[:tail]], f[:tail][large[:tail]]
                return {
                    "bucket": pa.array(np.concatenate([np.zeros(len(u), np.int64), over_b]), mask=np.arange(len(u) + len(over_b)) < len(u)),
                    "u": np.concatenate([u, over_f]), "v": np.concatenate([v, over_f]),
                }

            for batch in batches:
                yield split(
                    np.concatenate([held_b, batch.column(0).to_numpy()]), np.concatenate([held_f, batch.column(1).to_numpy()]), False
                )
            yield split(held_b, held_f, True)

        return step

    links, rows = None, prints.select(F.lit(0).cast("long").alias("bucket"), "fp")
    for family in range(FAMILIES):
        masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, family)])
        dealt = rows.select("bucket", "fp", F.posexplode(masks).alias("__table", "__mask")).select(
            F.xxhash64("bucket", "__table", F.col("fp").bitwiseAND(F.col("__mask"))).alias("bucket"), "fp"
        )
        sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
        found = materialise(map_batches(sorted_, compare(family == FAMILIES - 1), "bucket long, u long, v long", rows=1 << 16))
        new = found.where("bucket IS NULL").select("u", "v")
        links = new if links is None else links.unionByName(new)
        rows = found.where("bucket IS NOT NULL").select("bucket", F.col("u").alias("fp"))
        if rows.isEmpty():
            return links
    return links


def near_duplicates(
    docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, fp, component_id)``: the smallest id reachable over links of at most ``radius`` bits."""
    prints = materialise(fingerprints(docs, words, seed, id_col, text_col))
    entries = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("__least")))
    roots = components(near_links(entries, radius))
    joined = entries.join(roots, entries["fp"] == roots["node"], "left").select(
        "fp", "__least", F.coalesce("root", "fp").alias("__root")
    )
    least = joined.groupBy("__root").agg(F.min("__least").alias("component_id"))
    classes = joined.join(least, "__root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class of near-duplicates: that of the smallest id (null before all), then hash of the text."""
    own = keyed(docs, id_col, text_col)
    found = materialise(near_duplicates(own, id_col="__key", text_col=text_col))
    left = without(own, found.where("__key <> component_id"))
    repeats = found.where("__key = component_id").groupBy("__key").count().where("count > 1")
    if repeats.isEmpty():
        return left
    return keyed(left, id_col, text_col).dropDuplicates(["__key"]).drop("__key")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
