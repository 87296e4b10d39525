"""Fingerprints and near-duplicate classes against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pollspark.llm.graph import components
from pollspark.llm.simhash import covering_masks, fingerprint, near_duplicates, near_links, op7_simhash_near_dedup, star_links


def plain_fingerprint(text, words=3):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """Smallest id per row, by comparing all pairs."""
    keys = sorted(set(prints.values()))
    values = np.array(keys, dtype=np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ v) <= radius):
            root[find(i + 1 + int(j))] = find(i)
    least = {}
    for doc, fp in prints.items():
        c = find(keys.index(fp))
        least[c] = min(doc, least.get(c, doc))
    return {doc: least[find(keys.index(fp))] for doc, fp in prints.items()}


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(1)
    for radius in (1, 3):
        for family in range(4):
            masks = covering_masks(radius, family)
            assert len(masks) == 2 ** (radius + 1) - 1
            for _ in range(3000):
                diff = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(m & diff == 0 for m in masks)
            assert all(25 <= m.bit_count() <= 48 for m in masks)


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    root = classes(prints)
    got = {tuple(r) for r in op7_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {(d, f"{fp:016x}", root[d]) for d, fp in prints.items()}


@pytest.mark.parametrize("bucket", [50, 1 << 16])
def test_near_fingerprints_of_all_kinds(spark, bucket):
    rng = random.Random(bucket)
    prints = {}
    for _ in range(40):  # chains, tight balls, lone values
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            prints[len(prints)] = fp
            fp ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    rows = spark.createDataFrame([(d, fp - (1 << 64) if fp >> 63 else fp) for d, fp in prints.items()], "d long, fp long")
    links = near_links(rows.select("fp").distinct(), 3, bucket)
    roots = {r.node: r.root for r in components(links).collect()}
    found = {}
    for r in rows.collect():
        found.setdefault(roots.get(r.fp, r.fp), []).append(r.d)
    root = classes(prints)
    expected = {}
    for d, c in root.items():
        expected.setdefault(c, []).append(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_links_of_a_bucket_are_a_star():
    fp = np.arange(100, dtype=np.int64)
    u, v = star_links(np.zeros(100, np.int64), fp, 7)
    assert len(u) == 99
    assert set(v.tolist()) == {0}
    assert star_links(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)[0].size == 0


def test_odd_rows(spark):
    rows = [
        (7, "A b c d", "x"), (3, "a B C D", "y"), (3, "a B C D", "y"), (9, None, "z"), (4, " \n ", None), (5, "", "u"),
        (None, "one two", "v"), (8, "one\ttwo", "w"), (6, "é " * 50_000, "t"), (2, "É " * 50_000, "t"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fp, r.component_id) for r in got}
    assert {c for d, _, c in by if d in (3, 7)} == {3}
    assert {(f, c) for d, f, c in by if d in (4, 5, 9)} == {(0, 4)}
    assert {c for d, _, c in by if d in (None, 8)} == {8}
    assert {d: f % 2**64 for d, f, _ in by if d} == {d: plain_fingerprint(t) for d, t, _ in rows if d}
    assert near_duplicates(docs.limit(0)).collect() == []


def test_long_chain_and_star(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    star = spark.range(1001, 3000).select(F.lit(1000).cast("long").alias("u"), F.col("id").alias("v"))
    roots = components(chain.unionByName(star))
    assert {(r.root, r["count"]) for r in roots.groupBy("root").count().collect()} == {(0, 300), (1000, 2000)}
    assert components(chain.limit(0)).collect() == []


def test_fingerprint_of_a_very_long_text():
    text = " ".join(str(i * 7919 % 10007) for i in range(70_000))
    assert fingerprint(text) == plain_fingerprint(text)
