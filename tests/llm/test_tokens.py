"""Packing and token files against whole-text encoding by the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pollspark.llm import token_files
from pollspark.llm.packing import best_fit, op2_best_fit_packing, pack, packed_documents, pieces, ranked, sequences
from pollspark.llm.token_files import SUB, decode_sub, decode_words, encode_words, op3_token_files, read_token_files, write_token_files
from pollspark.llm.tokens import ChunkEncoder, vocabulary_path
from pyspark.sql import functions as F

ODD = [
    (5, "", 1), (3, None, 1), (3, None, 1), (9, " ", 2), (None, "no id", 0), (4, "a  b \n c\n\n", 0), (8, "x" * 30_000, 0),
    (2, "ab​c é 日本 語 😀", 0), (7, "word " * 9_000, 0), (1, "<|endoftext|> z", 0), (6, "it's  '5 we'll\t\tx", 0),
]
SCHEMA = "doc_id long, text string, piece int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def whole(tokenizer, text, end):
    return np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_chunks_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\ta1.é'日<x,") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += [t or "" for _, t, _ in ODD]
    coder = ChunkEncoder(vocabulary_path(), memo=2000)
    for i in range(0, len(texts), 512):
        for text, raw in zip(texts[i : i + 512], coder.encode(texts[i : i + 512]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, docs, tokenizer, capacity=2048):
    expected = Counter()
    total = 0
    for doc_id, text in docs:
        ids = whole(tokenizer, text, 0)
        total += len(ids)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[(doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        end = 0
        for offset, length in sorted(place):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), -(-total // capacity)


def test_packs_all_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    used, least = check_packing(op2_best_fit_packing(spark, sf_dir).collect(), docs, tokenizer)
    assert used <= 1.01 * least + 1


def test_packs_odd_rows(spark, tokenizer):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = packed_documents(docs).collect()
    check_packing(rows, [(a, b) for a, b, _ in ODD], tokenizer)
    assert packed_documents(docs.limit(0)).collect() == []
    placed = pack(pieces(docs, with_ids=True), ["doc_id", "piece", "ids_crc32"])
    made = {r.sequence_id: r.ids for r in sequences(placed).collect()}
    for r in placed.collect():
        assert made[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_plan_equals_placing_one_after_the_other():
    for seed in range(20):
        rng = random.Random(seed)
        counts = Counter(min(60, int(rng.expovariate(0.08)) + 1) for _ in range(400))
        runs, n = best_fit(counts, 60)
        bins = []
        for length in sorted(counts.elements(), reverse=True):
            room = [r for r in bins if r >= length]
            if room:
                bins.remove(min(room))
                bins.append(min(room) - length)
            else:
                bins.append(60 - length)
        assert n == len(bins)
        assert sum(b - a + 1 for _, a, b, *_ in runs) == 400


def test_refuses_impossible_lengths(spark):
    for bad in (0, 2049, None):
        with pytest.raises(ValueError):
            pack(spark.createDataFrame([(1, bad)], "k int, length int"), ["k"])


def test_ranks_of_a_hot_value(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, 9).otherwise(F.col("id") % 5).cast("int").alias("length"))
    found = defaultdict(list)
    for r in ranked(rows, "length", [F.col("k")], 5000, block=100).collect():
        found[r.length].append(r["__rank"])
    assert all(sorted(x) == list(range(len(x))) for x in found.values())


@pytest.mark.parametrize("kind", ["ids", "bits", "wide", "escapes", "empty", "ones"])
def test_words_round_trip(kind):
    rng = np.random.default_rng(4)
    values = {
        "ids": rng.integers(0, 50257, 70_001), "bits": rng.integers(0, 2, 999), "wide": (2 ** rng.uniform(0, 63.9, 5000)).astype(np.uint64),
        "escapes": np.asarray([2**64 - 1, 5, 2**60 - 1, 2**60] * 200, dtype=np.uint64), "empty": np.zeros(0), "ones": np.ones(128),
    }[kind].astype(np.uint64)
    payload = encode_words(values)
    assert np.array_equal(decode_words(payload), values)
    for i in range(-(-len(values) // SUB)):
        assert np.array_equal(decode_sub(payload, i), values[i * SUB : (i + 1) * SUB])
    if kind == "ids":
        assert len(payload) < 3 * len(values)


def check_files(rows, docs, tokenizer):
    start, expected = 0, []
    for doc_id, text in docs:
        ids = whole(tokenizer, text, 2)
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows, key=lambda r: r[1]) == expected


def test_files_of_all_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = op3_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    check_files([tuple(r) for r in rows], docs, tokenizer)


def test_files_of_odd_rows(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA)
    write_token_files(docs, str(tmp_path / "a"))
    rows = read_token_files(spark, str(tmp_path / "a"), with_ids=True).collect()
    order = sorted(((a, b) for a, b, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    check_files([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows], order, tokenizer)
    assert all(zlib.crc32(np.asarray(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    write_token_files(docs.limit(0), str(tmp_path / "b"))
    assert read_token_files(spark, str(tmp_path / "b")).collect() == []


def test_columns_that_are_called_like_ours(spark):
    rows = [(i, i % 7 + 1, "mine", -1, -2, -3, -4) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, length int, sequence_id string, first_rank int, per_sequence int, offset int, __size int")
    placed = pack(df, ["k"], 16)
    assert placed.columns == [*df.columns, "sequence_id_", "offset_"]
    found = placed.collect()
    assert sorted(tuple(r)[:7] for r in found) == rows
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id_, r.offset_)):
        assert filled.get(r.sequence_id_, 0) == r.offset_
        filled[r.sequence_id_] = r.offset_ + r.length
    assert max(filled.values()) <= 16


def test_many_rows_of_one_id_in_several_files(spark, tmp_path):
    from pollspark.llm.token_files import read_token_files, write_token_files

    df = spark.createDataFrame([(1 if i % 3 else None, f"text {i}") for i in range(3000)], "doc_id long, text string")
    write_token_files(df.repartition(8), str(tmp_path / "files"))
    found = read_token_files(spark, str(tmp_path / "files")).collect()
    assert len(found) == 3000
    end = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None] * 1000 + [1] * 2000


def test_token_files_remember_many_chunks():
    """A worker that has met 600,000 chunks learns none of them again."""
    coder = token_files.encoder(vocabulary_path(), token_files.MEMO)
    letters = str.maketrans("0123456789", "ghijklmnop")
    slices = [[" ".join(f"{i:x}".translate(letters) for i in range(a, a + 100)) for a in range(b, b + 10_000, 100)] for b in range(0, 600_000, 10_000)]
    first = [coder.encode(s) for s in slices]
    coder.memo.learn = lambda part: pytest.fail(f"{part} was forgotten")
    try:
        assert [coder.encode(s) for s in slices] == first
    finally:
        coder.memo.learn = coder.learn
