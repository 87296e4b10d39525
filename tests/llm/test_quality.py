"""Rule counts and a Kneser-Ney model against plain Python; both ways of scoring; bands; odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pollspark.llm import quality
from pollspark.llm.quality import (
    BATCH_BYTES, FLUSH, LEAST, LOWER, ORDERED, SHORT, STEPS, TRIPLE, UPPER, count_grams, gram_bits, gram_parts, judge, key_bits, model_arrays, op8_quality_rules,
)
from pollspark.session import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def plain_pieces(text):
    """Codes of the pieces of a text, from the definition, in arithmetic modulo 2 ** 64."""
    out = []
    for word in WORD.findall(text):
        word = re.sub("[0-9]", "0", word)
        units = [int.from_bytes(word.encode("utf-16-le")[i : i + 2], "little") for i in range(0, len(word.encode("utf-16-le")), 2)]
        for i in range(0, len(units), 2):
            pair = (units[i : i + 2] + [0])[:2]
            x = (i == 0) << 32 | pair[0] << 16 | pair[1]
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 32) * 0x94D049BB133111EB % 2**64
            out.append(((x ^ x >> 31) % (2**20 - 1) + 1) << 1 | (i == 0))
    return out


def plain_grams(text):
    line = [0, 0, *plain_pieces(text)]
    return [tuple(line[i : i + 3]) for i in range(len(line) - 2)]


def plain_model(texts):
    """Bits and order gain of each 3-gram by modified Kneser-Ney, from the definition; once seen is not seen."""
    grams = Counter(g for text in texts for g in plain_grams(text))
    counts = {3: grams}
    for k in (2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(table):
        n = {i: sum(c == i for c in table.values()) for i in range(1, 5)}
        out = {}
        for i, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
            d = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i] if n[i] and n[1] else 0
            out[i] = d if d > 0 else default
        return out

    d = {k: discounts(counts[k]) for k in counts}
    by_context = {k: defaultdict(list) for k in counts}
    for k, table in counts.items():
        for g, c in table.items():
            by_context[k][g[:-1]].append(c)
    sums = {k: {g: (sum(v), sum(d[k][min(c, 3)] for c in v)) for g, v in by_context[k].items()} for k in counts}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        n, (total, gamma) = counts[k][g], sums[k][g[:-1]]
        return ((n - d[k][min(n, 3)]) / total if n > 1 else 0) + gamma / total * p(g[1:])

    begins = Counter()
    for g, n in grams.items():
        if g[-1] & 1:
            begins[g[-1]] += n
    words = sum(begins.values())
    bits = {g: -math.log2(p(g)) for g in grams}
    return {g: (b, math.log2(words / begins[g[-1]]) - b if g[-1] & 1 else 0.0) for g, b in bits.items()}


def packed(gram):
    return gram[0] << 42 | gram[1] << 21 | gram[2]


def test_model_follows_the_definition(spark):
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choice(["the", "thé", "a", "on", "x#", "19a7"]) for _ in range(rng.randint(0, 30)))) for _ in range(60)]
    rows += [(None, "une deux  trois\nquatre une"), ("en", None)]
    counts = materialise(count_grams(spark.createDataFrame(rows, "lang string, text string")))
    got = defaultdict(dict)
    for r in gram_bits(counts).collect():
        got[r.lang][r.gram] = (r.bits, r.gain)
    for lang in ("en", None):
        expected = plain_model([t or "" for k, t in rows if k == lang])
        assert set(got[lang]) == {packed(g) for g in expected}
        for g, pair in expected.items():
            assert got[lang][packed(g)] == pytest.approx(pair)


def test_sent_model_has_no_key_counted_once(spark, sf_dir):
    """The arrays that tasks get hold the keys counted more than once only, and give every key's bits and gain."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").limit(200)
    docs = docs.unionByName(spark.createDataFrame([(None, "une deux trois quatre"), ("xx", "a b " * 9)], "lang string, text string"))
    counts = materialise(count_grams(docs))
    n = {(r.lang, r.gram): r.n for r in counts.collect()}
    full = gram_bits(counts).collect()
    parts = model_arrays(gram_parts(counts))
    twice = Counter(lang for (lang, _), times in n.items() if times > 1)
    assert {lang: len(own[TRIPLE][0]) for lang, own in parts.items() if TRIPLE in own} == twice
    assert 2 * sum(twice.values()) < len(n) == len(full)
    for lang in parts:
        rows = [r for r in full if r.lang == lang]
        bits, gain = key_bits(parts[lang], np.array([r.gram for r in rows], dtype=np.uint64))
        assert bits == pytest.approx([r.bits for r in rows], abs=1e-5)
        assert gain == pytest.approx([r.gain for r in rows], abs=1e-5)


@pytest.mark.parametrize("entries", [0, 10**6])
def test_no_key_is_rare(spark, entries):
    """No key is counted once or twice: the discounts' formula has no denominator."""
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten", "en") for i in range(7)], "doc_id long, text string, lang string")
    found = judge(docs, broadcast_entries=entries).collect()
    assert len(found) == 7 and len({r.perplexity for r in found}) == 1 and all(r.kept and r.perplexity > 1 for r in found)


@pytest.mark.parametrize("entries", [0, 10**6])
def test_tasks_hold_few_bytes_of_text(spark, monkeypatch, entries):
    """Texts come to the tasks some ``BATCH_BYTES`` at a time, keys leave them ``FLUSH`` at a time, and the session's setting stays."""
    schemas = []

    def watched(df, step, schema):
        def looked(batches):
            def each():
                for batch in batches:
                    assert batch.get_total_buffer_size() <= 3 * BATCH_BYTES, "a task holds a large batch"
                    yield batch

            for columns in step(each()):
                assert len(next(iter(columns.values()))) <= FLUSH, "a task returns a large batch"
                yield columns

        schemas.append(schema)
        return original(df, looked, schema)

    original = quality.map_batches
    monkeypatch.setattr(quality, "map_batches", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    words = "translate(sha2(concat(id, '-', x), 256), '0123456789', 'qwertyuiop')"
    docs = spark.range(300, numPartitions=1).selectExpr("id AS doc_id", "'en' AS lang", f"array_join(transform(sequence(1, 400), x -> {words}), ' ') AS text")
    assert docs.selectExpr("sum(length(text))").first()[0] > 6 * BATCH_BYTES
    found = judge(docs, broadcast_entries=entries)
    assert found.count() == 300 and found.where("n_words = 400").count() == 300
    assert len(schemas) == 2 and spark.conf.get(key) == before


def lower_median(values):
    return sorted(values)[(len(values) - 1) // 2]


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()
    rows = {r.doc_id: r for r in op8_quality_rules(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    means, gains, passed = {}, {}, defaultdict(list)
    for lang in {d.lang for d in docs}:
        own = [d for d in docs if d.lang == lang]
        model = plain_model([d.text for d in own])
        for d in own:
            words, found = WORD.findall(d.text), plain_grams(d.text)
            spoken = sum(bool(re.search(r"[^!-/:-@\[-`{-~]", w)) for w in words)
            means[d.doc_id] = (sum(model[g][0] for g in found) / max(1, spoken), max(1, spoken))
            gains[d.doc_id] = sum(model[g][1] for g in found) / max(1, len(words))
    for d in docs:
        r, counts = rows[d.doc_id], plain_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        if not r.base_failed:
            passed[d.lang].append(d.doc_id)
    for ids in passed.values():
        middle, down, up = {}, {}, {}
        for name, of in (("bits", lambda i: means[i][0]), ("gain", lambda i: gains[i])):
            steps = [round(of(i) * STEPS) for i in ids]
            middle[name] = lower_median(steps) / STEPS
            for side, into in ((-1, down), (1, up)):
                away = [side * (v - lower_median(steps)) for v in steps if side * (v - lower_median(steps)) >= 0]
                into[name] = max(LEAST, 1.4826 * lower_median(away) / STEPS)
        for i in ids:
            mean, spoken = means[i]
            wider = math.sqrt(1 + SHORT / spoken)
            assert rows[i].bits_per_word == pytest.approx(mean, abs=1e-4)
            assert rows[i].order_gain == pytest.approx(gains[i], abs=1e-4)
            room = min(
                mean - middle["bits"] + LOWER * down["bits"] * wider, middle["bits"] + UPPER * up["bits"] * wider - mean,
                gains[i] - middle["gain"] + ORDERED * down["gain"] * wider,
            )
            if abs(room) > 0.02:
                assert rows[i].kept == (room > 0)
    assert not any(r.kept for r in rows.values() if r.base_failed)


def test_keeps_clean_and_rejects_junk(spark, sf_dir):
    """Clean texts stay and labelled junk goes, also beside junk of some 10 % made of clean texts' words and letters."""
    folder = sf_dir.replace("sf0.001", "sf0.1").replace("sf0.01", "sf0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rng = random.Random(3)
    found = docs.collect()
    clean = [r for r in found if labels.get(r.doc_id) == 1 and len((r.text or "").split()) >= 200]
    lexicon = defaultdict(list)
    for r in found:
        lexicon[r.lang] += (r.text or "").split()
    junk = []
    for i, r in enumerate(rng.sample(clean, 300)):
        words = r.text.split()
        rng.shuffle(words)
        junk.append((-1 - 3 * i, r.lang, " ".join(words)))
        junk.append((-2 - 3 * i, r.lang, " ".join(rng.choice(lexicon[r.lang]) for _ in range(200))))
        junk.append((-3 - 3 * i, r.lang, "".join(rng.sample(r.text, len(r.text)))))
    both = docs.unionByName(spark.createDataFrame(junk, "doc_id long, lang string, text string"))
    alone, beside = ({r.doc_id: r for r in judge(t).collect()} for t in (docs, both))
    for got in (alone, beside):
        judged = [r for r in got.values() if r.doc_id in labels and not r.base_failed]
        good = [r.kept for r in judged if labels[r.doc_id] == 1]
        bad = [r.kept for r in judged if labels[r.doc_id] == 0]
        assert sum(good) >= 0.99 * len(good)
        assert sum(bad) <= 0.2 * len(bad)
    assert sum(beside[i].kept != r.kept for i, r in alone.items()) <= 0.02 * len(alone)
    for kind in range(3):
        assert sum(beside[-1 - kind - 3 * i].kept for i in range(300)) <= 30


ODD = [
    (1, None, "en", 1), (2, "", "en", 1), (3, " \n\t", "en", 1), (4, "a b c d e f g h i j", None, 1), (4, "a b c d e f g h i j", None, 1),
    (None, "😀 " * 40 + "b", "en", 1), (5, "the cat sat on " * 5000, "en", 1), (6, "### *** " * 20 + "a", "xx", 1),
    (7, "one two three four five six seven eight nine ten\n" * 2, "en", 1), (8, "the quick\r\nbrown fox\x0bjumps over one lazy dog once more", "en", 2),
]


def test_odd_rows_and_both_ways_of_scoring(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, kept int")
    a = judge(docs).collect()
    b = judge(docs, broadcast_entries=0).collect()
    assert len(a) == len(b) == len(ODD)
    key = lambda r: (str(r.doc_id), r.n_words)
    for x, y, (doc_id, text, *_) in zip(sorted(a, key=key), sorted(b, key=key), sorted(ODD, key=lambda r: (str(r[0]), len(WORD.findall(r[1] or "")))), strict=True):
        assert (x.doc_id, x.kept, x.base_failed, x.n_words) == (y.doc_id, y.kept, y.base_failed, y.n_words)
        assert x.perplexity == pytest.approx(y.perplexity, rel=1e-4)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain_counts(text or "")
    assert judge(docs.limit(0)).collect() == []
