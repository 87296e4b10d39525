"""Licence scans by a positional index of rare words.

Templates are word lists. The corpus's document counts of their words (one counting
pass, a bounded table) give each word an IDF, and a template is indexed under its
highest-IDF words with their positions: one word more than a match may lack, so every
place that matches is hit. A file looks up all its words in that index; every hit
names a template and, by the difference of positions, where the template would start,
give or take ``DRIFT`` places for long ones. These starts are verified word by word,
and the template's key phrases must stand complete. Of starts within ``DRIFT`` of each
other the best one is a match.

The base phrases are templates whose words must all match. Each occurrence contains
its phrase's rarest word, so no place is missed.

Cases: a null or wordless text has no words, labels or places and score 0; repeated
rows are scanned each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm.common import map_batches, table, texts

#: Phrases that label a file by themselves.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, wording, and phrases of it that must be complete.
TEMPLATES = [
    ("gpl-2.0", "gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["general public license", "version 3"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public"]),
    ("agpl", "gnu affero general public license", ["affero general public"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it"]),
    ("apache-2.0", "apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["hereby granted free of charge", "deal in the software without restriction"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "eclipse public license version", ["eclipse public license"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("released-mit", "released under the mit license", ["mit license"]),
]
#: Part of a template's words that must match.
COVER = 0.8
#: Places by which a word of a long template may be off, after small insertions or losses.
DRIFT, LONG = 3, 12

_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _OTHER, bytes(range(97, 123)) + b" " * len(_OTHER))


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Index:
    """Postings of the templates' rarest words: word to (template, position in it)."""

    def __init__(self, idf: Mapping[bytes, float], base: Mapping[str, str] = BASE, templates=TEMPLATES):
        self.templates = [(label, words(phrase), [], True) for phrase, label in base.items()]
        self.templates += [(label, words(text), [words(k) for k in keys], False) for label, text, keys in templates]
        self.keys = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text, keys, exact) in enumerate(self.templates):
            order = sorted(range(len(text)), key=lambda p: (-idf.get(text[p], 0.0), text[p], p))
            lacking = 0 if exact else len(text) - math.ceil(COVER * len(text) - 1e-9)
            for p in order[: lacking + 1]:
                self.postings[text[p]].append((number, p))
            self.keys.append([(p, k) for k in keys for p in range(len(text) - len(k) + 1) if text[p : p + len(k)] == k])
        self.rare = frozenset(self.postings)

    def scan(self, found: list[bytes]) -> tuple[list[tuple[str, int, int, float, bool]], float]:
        """``(label, first word, words, cover, base)`` of each match, and the best cover of any candidate."""
        hits = self.rare.intersection(found)
        if not hits:
            return [], 0.0
        starts: dict[int, set[int]] = defaultdict(set)
        for at, word in enumerate(found):
            if word in hits:
                for number, p in self.postings[word]:
                    drift = self.drift(number)
                    starts[number].update(range(at - p - drift, at - p + drift + 1))
        matches, best = [], 0.0
        for number, places in starts.items():
            label, text, _, exact = self.templates[number]
            if exact:
                same = [s for s in places if s >= 0 and found[s : s + len(text)] == text]
                matches += [(label, s, len(text), 1.0, True) for s in same]
                best = 1.0 if same else best
                continue
            drift, held = self.drift(number), None
            for start in sorted(places):
                cover = self.cover(found, start, text, drift)
                best = max(best, cover)
                if cover < COVER or not all(self._stands(found, start + p, key, drift) for p, key in self.keys[number]):
                    continue
                # Of starts that drift lets match alike, the one with most words in their very places.
                this = (cover, self.cover(found, start, text, 0), -start)
                if held is not None and start + held[2] > drift:
                    matches.append((label, max(0, -held[2]), len(text), held[0], False))
                    held = None
                held = this if held is None else max(held, this)
            if held is not None:
                matches.append((label, max(0, -held[2]), len(text), held[0], False))
        return sorted(matches), best

    def drift(self, number: int) -> int:
        _, text, _, exact = self.templates[number]
        return DRIFT if len(text) >= LONG and not exact else 0

    @staticmethod
    def cover(found: list[bytes], start: int, text: list[bytes], drift: int) -> float:
        """Part of the template's words that stand where they would, give or take ``drift`` places."""
        return sum(w in found[max(0, start + p - drift) : max(0, start + p + drift + 1)] for p, w in enumerate(text)) / len(text)

    @staticmethod
    def _stands(found: list[bytes], at: int, key: list[bytes], drift: int) -> bool:
        return any(a >= 0 and found[a : a + len(key)] == key for a in range(at - drift, at + drift + 1))


def inverse_frequencies(docs: DataFrame, text_col: str = "text", vocabulary: frozenset[bytes] | None = None) -> dict[bytes, float]:
    """IDF of the templates' words over all texts; tasks send one row per word, the driver holds the vocabulary."""
    if vocabulary is None:
        vocabulary = frozenset(w for phrase in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in words(phrase))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, counts = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                for word in vocabulary.intersection(words(text)):
                    counts[word] += 1
        yield {"word": [None, *counts], "n": [n, *counts.values()]}

    found = map_batches(texts(docs, text_col), step, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()
    counts = {None if r[0] is None else bytes(r[0]): r[1] for r in found}
    total = counts.pop(None, 0)
    return {w: math.log((total + 1) / (n + 1)) for w, n in counts.items()}


MATCH = "array<struct<label: string, first: long, n_words: long, cover: double, base: boolean>>"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, matches, score)`` of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    index = Index(inverse_frequencies(docs, text_col))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            scans = [index.scan(f) for f in found]
            yield {
                "id": batch.column(0), "n": np.fromiter(map(len, found), np.int64, len(found)),
                "matches": [[dict(zip(("label", "first", "n_words", "cover", "base"), m, strict=True)) for m in s] for s, _ in scans],
                "score": [s for _, s in scans],
            }

    return map_batches(texts(docs, text_col, id_col), step, f"`{id_col}` {kind}, n_words long, matches {MATCH}, score double")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every document."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])

    def joined(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    firsts = F.transform(base, lambda m: m["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"), "score",
    )
