"""Spelling variants: words one edit apart, found by PartEnum signatures on letter multisets.

A word's letters with their repeats are a set: the i-th occurrence of a letter is an
element. One inserted, deleted or replaced code point changes at most two elements, so
near words have sets of Hamming distance at most two. All elements are dealt into
``GROUPS`` groups, each of ``PARTS`` parts. Of two changes at most ``LOST`` fall into
some group, so in that group all but ``LOST`` parts are equal: a signature is a group,
a choice of ``PARTS - LOST`` parts and the word's elements in them, and every near pair
shares one. Each signature is joined with the word's first or last letters: an edit
leaves one of the two unchanged, so this splits buckets and loses no pair. Words of equal
signature are joined and verified by their edit distance.

Counting is a partial sum per slice of texts before the shuffle; everything after it
works on the distinct words. No bucket is gathered: pairs come from an equi-join, which
splits large keys, and are verified before they are made distinct.

Cases: null and empty texts have no words; a null id counts as the empty string in the
hash that deletes letters; repeated rows count each; equal counts of two near words go to
the first in code-point order; no words or an empty table give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm.common import crc32_sql, map_batches, table
from pollspark.session import materialise

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least this many times as frequent as its variant.
TIMES = 5
#: One run in so many loses a letter.
TYPO = 199
#: Groups of elements, parts of a group, and parts of it that two changes may touch.
GROUPS, PARTS = 1, 6
LOST = 2 // GROUPS
#: Code points of a text searched at a time, so that a very long text needs bounded memory.
WINDOW = 1 << 20

_RUN = re.compile(f"[{LETTERS}]+")
_END = re.compile(f"[^{LETTERS}]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def runs(text: str, window: int = WINDOW) -> Iterator[list[str]]:
    """The letter runs of a text, those of some ``window`` code points at a time."""
    start = 0
    while start < len(text):
        end = start + window
        if end < len(text):
            stop = _END.search(text, end)
            end = stop.start() if stop else len(text)
        yield _RUN.findall(text[start:end].translate(_LOWER))
        start = end


def typed(run: str, crc: int) -> str:
    """The run, without one letter where its hash says so."""
    h = zlib.crc32(run.encode(), crc)
    if h % TYPO:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT
) -> DataFrame:
    """``(word, n)``: words of at least ``letters`` code points that occur at least ``least`` times."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = Counter()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter()
                for some in runs(text):
                    own.update(run for run in some if len(run) >= letters)
                crc = zlib.crc32(f"{key}:".encode())
                for run, n in own.items():
                    found[typed(run, crc)] += n
            words = [w for w in found if len(w) >= letters]
            yield {"word": words, "n": [found[w] for w in words]}

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    counted = map_batches(rows, step, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def parts_of(word: str) -> list[int]:
    """A hash of the word's elements in each part."""
    parts = [f"{p}:" for p in range(GROUPS * PARTS)]
    seen = Counter()
    for letter in sorted(word):
        element = f"{letter}{seen[letter]}"
        parts[part_of(element)] += f"{element},"
        seen[letter] += 1
    return [xxhash.xxh64_intdigest(p) for p in parts]


@lru_cache(maxsize=1 << 16)
def part_of(element: str) -> int:
    return xxhash.xxh32_intdigest(element) % (GROUPS * PARTS)


def choices() -> np.ndarray:
    """A row for each signature, 1 for the parts that it takes."""
    kept = [c for g in range(GROUPS) for c in combinations(range(g * PARTS, (g + 1) * PARTS), PARTS - LOST)]
    return np.array([[p in c for p in range(GROUPS * PARTS)] for c in kept], dtype=np.uint64)


def signatures(words: list[str], affix: int) -> np.ndarray:
    """One row a word: its PartEnum signatures, each with its first and with its last ``affix`` letters."""
    if not words:
        return np.zeros((0, 2 * len(choices())), dtype=np.int64)
    elements = np.array([parts_of(w) for w in words], dtype=np.uint64) @ choices().T
    ends = [[xxhash.xxh64_intdigest(f"<{w[:affix]}"), xxhash.xxh64_intdigest(f">{w[-affix:]}")] for w in words]
    both = elements[:, None, :] + np.array(ends, dtype=np.uint64)[:, :, None]
    return both.reshape(len(words), -1).view(np.int64)


def near_pairs(words: DataFrame, letters: int = LEAST_LETTERS) -> DataFrame:
    """Distinct pairs (``u``, ``nu``, ``v``, ``nv``), ``u`` before ``v``, of ``(word, n)`` that are one edit apart.

    ``letters`` is a length that no word falls short of; half of it is the affix.
    """
    affix = letters // 2

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own = signatures(batch.column(0).to_pylist(), affix)
            at = pa.array(np.repeat(np.arange(len(own)), own.shape[1]))
            yield {"signature": own.reshape(-1), "word": batch.column(0).take(at), "n": batch.column(1).take(at)}

    signed = materialise(map_batches(words.select("word", "n"), step, "signature long, word string, n long"))
    one = signed.select("signature", F.col("word").alias("u"), F.col("n").alias("nu"))
    other = signed.select("signature", F.col("word").alias("v"), F.col("n").alias("nv"))
    near = (F.col("u") < F.col("v")) & (F.abs(F.length("u") - F.length("v")) <= 1) & (F.levenshtein("u", "v", 1) == 1)
    return one.join(other, "signature").where(near).select("u", "nu", "v", "nv").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` by pointer jumping over ``(word, form)``.

    A form is ``TIMES`` times as frequent as its word, so paths are short and have no circles.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        jumped = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), "__next"))
        now = jumped.select("word", "root")
        if jumped.where("__next IS NOT NULL").isEmpty():
            return now


def variants(words: DataFrame, letters: int = LEAST_LETTERS, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for the distinct words ``(word, n)``."""
    words = materialise(words.select("word", "n"))
    pairs = materialise(near_pairs(words, letters))
    both = pairs.select(F.col("u").alias("word"), "nu", F.col("v").alias("other"), F.col("nv").alias("of")).unionByName(
        pairs.select(F.col("v").alias("word"), F.col("nv").alias("nu"), F.col("u").alias("other"), F.col("nu").alias("of"))
    )
    best = F.min(F.struct((-F.col("of")).alias("of"), "other"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.max("nu").alias("nu"))
    enough = -F.col("best.of") >= times * F.col("nu")
    near = materialise(near.select(
        "word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.of")).alias("form_n")
    ))
    roots = last_forms(near.where("form IS NOT NULL"))
    joined = words.join(near, "word", "left").join(roots, "word", "left")
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, more frequent form and root."""
    return variants(word_counts(table(spark, sf_dir, "documents")))


# Near words share what is left when one code point is taken out.
ORACLE_SQL = f"""
WITH RECURSIVE found AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
),
own AS (SELECT id || ':' || run AS s, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("s")} AS h FROM own),
typed AS (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed
),
words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
cut AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS of_other
    FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
),
placed AS (
    SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY of_other DESC, other) AS place
    FROM near
),
best AS (
    SELECT word, n_near, CASE WHEN of_other >= 5 * n THEN other END AS form, CASE WHEN of_other >= 5 * n THEN of_other END AS form_n
    FROM placed WHERE place = 1
),
path AS (
    SELECT word, word AS root, 0 AS steps FROM words
    UNION ALL SELECT p.word, b.form, p.steps + 1 FROM path p JOIN best b ON p.root = b.word WHERE b.form IS NOT NULL
),
last AS (SELECT word, arg_max(root, steps) AS root FROM path GROUP BY word)
SELECT w.word, b.form, l.root, w.n, coalesce(b.n_near, 0) AS n_near, b.form_n
FROM words w JOIN last l ON w.word = l.word LEFT JOIN best b ON w.word = b.word
"""
