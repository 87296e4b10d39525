"""Exact top-k, spelling variants and the conversation trie against plain Python."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from pollspark.llm import spelling, topk, trie
from pollspark.llm.catalog import QUERIES, SQL

NEW = ["op11_exact_top_k", "op12_spelling_variants", "op13_conversation_trie"]


@pytest.mark.parametrize("name", NEW)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) == []


# Exact top-k.

VECTORS = "vec_id long, embedding array<float>, block int, place string"


def plain_top(rows, every=50, k=5):
    kept = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for a, (query, w) in enumerate(kept):
        if query is None or query % every:
            continue
        scores = [(-sum(x * y for x, y in zip(w, u, strict=False)), b, i) for b, (i, u) in enumerate(kept) if a != b]
        out += [(query, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def top(spark, rows, schema=VECTORS):
    df = spark.createDataFrame(rows, schema)
    found = topk.numbered(topk.sparse_rows(df, "vec_id", "embedding"))
    best = topk.search(found.where(F.col("id") % 50 == 0), found)
    return Counter(tuple(r) for r in best.select("query_id", "rank", "id", "score").collect())


def test_top_k_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) / 3 for x in ((i * 7) % 11 - 5, i % 5 - 2, 0, i % 3)]) for i in range(40, 120)]
    rows += [(50, [1.0, -2.0, 0.5, 0.0]), (50, [1.0, -2.0, 0.5, 0.0]), (None, [9.0, 9.0, 9.0, 9.0])]  # repeated rows, null id
    rows += [(150, None), (200, [1.0, None, 0.0, 0.0]), (250, [nan, 0.0]), (300, [inf, 0.0]), (301, [-inf, 0.0])]
    rows += [(350, [0.0] * 4), (400, []), (450, [3.0]), (500, [0.1] * 9)]  # zeros, empty, other lengths
    rows = [(*r, 1, "x") for r in rows]
    assert top(spark, rows) == plain_top(rows)


def test_top_k_ties_few_rows_and_empty_tables(spark):
    same = [(i, [0.5, 0.5], 0, "") for i in range(0, 300)]
    found = top(spark, same)
    assert found == plain_top(same)
    assert found[(100, 1, 0, 32768)] == 1 and found[(0, 1, 1, 32768)] == 1
    two = [(0, [1.0], 0, ""), (1, [2.0], 0, "")]
    assert top(spark, two) == Counter({(0, 1, 1, 256 * 512): 1})
    assert top(spark, [(0, [1.0], 0, "")]) == Counter()
    assert top(spark, []) == Counter()
    assert top(spark, [(1, [1.0], 0, ""), (2, [1.0], 0, "")]) == Counter()  # no query


@pytest.mark.parametrize(("block", "query", "scores"), [(64, 64, 100), (1000, 200, 1 << 20), (64, 1 << 20, 64)])
def test_top_k_does_not_depend_on_blocks(spark, monkeypatch, block, query, scores):
    monkeypatch.setattr(topk, "BLOCK_WEIGHTS", block)
    monkeypatch.setattr(topk, "QUERY_WEIGHTS", query)
    monkeypatch.setattr(topk, "SCORES", scores)
    rng = random.Random(block)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-2, 2)]) for _ in range(6)], 0, "") for i in range(400)]
    assert top(spark, rows) == plain_top(rows)


def test_best_of_a_block():
    scores = np.array([3, 5, 5, 1, 5, topk.NONE, 4])
    assert topk._best(scores, 2).tolist() == [1, 2]
    assert topk._best(scores, 5).tolist() == [1, 2, 4, 6, 0]
    assert topk._best(scores, 9).tolist() == [1, 2, 4, 6, 0, 3]


# Spelling variants.

DOCS = "doc_id long, text string, word string, n long, root string"


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_variants(docs):
    counts = Counter()
    for key, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    others = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= 5 * words[w] else None for w, o in others.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(others[w]), words.get(form[w])) for w, n in words.items()}


def variants(spark, docs):
    df = spark.createDataFrame([(*d, "w", 1, "r") for d in docs], DOCS)
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(spelling.word_counts(df)).collect()}


def test_variants_cases(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WINDOW", 50)  # texts cut many times
    rng = random.Random(3)
    base = ["straße", "überaus", "garden", "gardens", "kitchen", "ÀÉÎÕÜÿ", "aaaaaa", "abcabcabc", "listen", "silent"]
    words = []
    for w in base:
        words += [w] * 130 + [w.upper()] * 6
        for _ in range(4):
            i = rng.randrange(len(w))
            edited = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeß") + w[i:], w[:i] + "y" + w[i + 1 :]])
            words += [edited] * rng.choice([4, 5, 7, 26])
            words += [edited[:3] + "q" + edited[3:]] * 5
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", ", ", "1", "\n×"]).join(words[i::40])) for i in range(40)]
    docs += [(None, " ".join(base * 3)), (1, None), (2, ""), (3, "×÷ 123"), (5, " ".join(words)), (5, " ".join(words))]
    found = variants(spark, docs)
    assert found == plain_variants(docs)
    assert any(form and root != form for _, form, root, *_ in found)  # a path of two steps
    assert variants(spark, []) == set()
    assert variants(spark, [(1, "one two three")]) == set()


def test_equal_counts_go_to_the_first_word(spark):
    docs = [(i, "gardex gardey " * 40 + "garden ") for i in range(5)]
    assert variants(spark, docs) == plain_variants(docs)


def test_one_edit_shares_a_signature():
    rng = random.Random(5)
    letters = "aabeeinrstüß"
    for _ in range(3000):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 14)))
        i = rng.randrange(len(w))
        v = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        one, other = spelling.signatures([w, v], 3)
        assert set(one) & set(other)


def test_typed():
    for run in ("gardening", "überaus"):
        for doc in range(1000):
            h = zlib.crc32(f"{doc}:{run}".encode())
            i = h % len(run)
            assert spelling.typed(run, zlib.crc32(f"{doc}:".encode())) == (run if h % 199 else run[:i] + run[i + 1 :])


# Conversation trie.

TURNS = "conv_id long, turn long, role string, text string, depth int, f string, token int"


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    convs = {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}
    paths = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, inside in nodes.items():
        words = len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in p[-1][1]).split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(inside) - 1) * words
    return {
        (min(inside), len(p), min(nodes[p[:-1]]) if p else None, len(inside), children[p], leaves[p], saved[p],
         sha256(",".join(map(str, sorted(c for c in inside if paths[c] == p))).encode()).hexdigest())
        for p, inside in nodes.items()
    }


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], TURNS)
    got = [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some_turns(seed=1):
    rng = random.Random(seed)
    said = [("user", "hello  there"), ("user", "hello there"), ("assistant", "a b\tc"), (None, "x"), ("user", None), ("", "x"), ("userx", "")]
    rows = []
    for c in [*range(0, 95), 105, 200, 207]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, turn if rng.random() < 0.9 else None, *rng.choice(said)))
    rows += [r for r in rows if r[0] in (3, 17)]  # repeated rows
    rows += [(None, 1, "user", "lost"), (41, 7, "user", "x " * 3000)]
    return rows


def test_trie_cases(spark):
    rows = some_turns()
    found = nodes_of(spark, rows)
    assert found == plain_trie(rows)
    assert nodes_of(spark, []) == set()
    assert nodes_of(spark, [(None, 1, "user", "a")]) == set()
    one = [(21, 0, "user", "only turn")]  # base absent, and less than its head
    assert nodes_of(spark, one) == plain_trie(one)


def test_a_long_conversation_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 16)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = some_turns(2) + [(300, t, "user", f"turn {t % 7}") for t in range(700)]
    rows += [(301 + c, t, "user", f"turn {t}") for c in range(30) for t in range(6)]  # a common conversation
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_references_stand_for_the_texts(spark):
    rows = [r for r in some_turns(4) if r[0] is not None]
    df = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], TURNS)
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""), (r[2] or "", r[3] or "")))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    for node in trie.prefix_trie(df).where("depth > 0").collect():
        c, h = node["conv_id"], zlib.crc32(str(node["conv_id"]).encode()) % 4
        path = convs.get(c - c % 20, [])[:h] + convs[c][h:]
        assert convs[node["ref_conv"]][node["ref_pos"] - 1] == path[node["depth"] - 1]


def test_a_collision_is_found_and_another_seed_taken(spark, monkeypatch):
    rows = spark.createDataFrame([(*r, 1, "f", 2) for r in some_turns()], TURNS)
    opened = trie.openings(trie.turn_rows(rows, 0)).withColumn("h0", F.lit(0)).withColumn("h1", F.lit(0))
    planned = trie.plans(opened)
    with pytest.raises(trie.Collision):
        trie.node_rows(trie.members(opened, planned), planned)
    real, seeds = trie.turn_rows, []

    def first_fails(df, seed):
        seeds.append(seed)
        if seed == 0:
            raise trie.Collision("turns")
        return real(df, seed)

    monkeypatch.setattr(trie, "turn_rows", first_fails)
    assert nodes_of(spark, some_turns()) == plain_trie(some_turns())
    assert seeds == [0, 1]
