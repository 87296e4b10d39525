"""Quality rules: counts over words and lines, and language-specific perplexity bands.

The language model is a modified Kneser-Ney model of order 3 over subword pieces:
words in order, digits as one, cut into pieces of two UTF-16 units; a piece's code
tells whether it begins a word. Three codes pack into one 64-bit key (codes are 20-bit
hashes, so two of a language's pieces rarely share one). Spark counts the keys of all
documents: tasks pre-aggregate, one shuffle adds up, and the lower orders, discounts
and interpolated probabilities follow from that table by joins and aggregates. Keys
span word ends, so their number grows with the corpus, far slower than that of word
n-grams. A key counted once is its own text's and is judged as if it had not been seen.
Every key a text can ask for has been counted, so the model stores one number per key
counted more than once, per pair of pieces and per context, in sorted arrays by language;
a key counted once has its context's and its pair's.

Two figures of a text meet their language's limits, all in robust deviations from the
median: perplexity (two to the bits per word, where a word of ASCII punctuation alone
does not count), above and below, and the order gain: the bits that the pieces in front
save at beginnings of words against word beginnings in no order. Symbols, capitals and
rare words cost bits; texts of shuffled or random words lose the gain. Deviations are
median distances of one side, so junk hardly moves them, and grow for short texts (by
the root of 1 + ``SHORT`` / words). Medians are exact, over all texts that pass the
counting rules, on values rounded to 1 / ``STEPS`` bits.

Cases: a null text has no words; a null language is a language of its own; a text
without words or with fewer than ten fails; repeated rows are judged alike, each on
its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.llm.common import keyed, map_batches, table, without
from pollspark.session import arrow_batches, materialise

ORDER = 3
#: UTF-16 units of a piece, and bits of a piece's code; ``ORDER`` codes fit a signed 64-bit key.
#: The lowest bit of a code is set where a word begins.
PIECE, BITS = 2, 21
#: Code in front of a text; no piece has it.
START = 0
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Limits in robust deviations (1.4826 x median distance of one side, at least ``LEAST`` bits) from a
#: language's median: bits per word below and above, order gain below. Limits are wider for short texts.
LOWER, UPPER, ORDERED = 9.0, 4.5, 3.0
SHORT, LEAST = 50, 0.02
STEPS = 1024
#: Steps of a coarse cell of the histograms.
CELL = 256
#: All digits count as one: numbers and codes are no matter of language.
DIGITS = bytes.maketrans(b"123456789", b"000000000")
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Parts of a broadcast model, and the pieces in a key of each.
TRIPLE, PAIR, CONTEXT, BEGIN = 3, 2, 0, 1
PIECES = {TRIPLE: 3, PAIR: 2, CONTEXT: 2, BEGIN: 1}
#: Keys a task holds before it merges them, and keys counted more than once (12 bytes each) that
#: may be broadcast; a larger model is joined by key instead.
HELD = 2_000_000
#: Bytes of texts that Spark sends to a task at a time (arrays over them take some 50 times as much), and
#: rows of keys that a task returns at a time.
BATCH_BYTES = 1 << 20
FLUSH = 1 << 16
BROADCAST_ENTRIES = 8_000_000
SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def _units(words: list[bytes]) -> np.ndarray:
    line = b" ".join(words).translate(DIGITS).decode("utf-8", "surrogatepass")
    return np.frombuffer(line.encode("utf-16-le", "surrogatepass"), dtype="<u2")


def codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all pieces of several texts, and the text each belongs to."""
    units = [_units(words) for words in texts]
    space = np.full(1, 0x20, dtype=np.uint16)
    flat = np.concatenate([part for own in units for part in (own, space)] or [space]).astype(np.uint64)
    gap = flat == 0x20
    place = np.arange(len(flat))
    begin = np.maximum.accumulate(np.where(gap, place, -1)) + 1
    at = np.flatnonzero(~gap & ((place - begin) % PIECE == 0))
    code = (at == begin[at]).astype(np.uint64)
    alive = np.ones(len(at), dtype=bool)
    for k in range(PIECE):
        there = np.minimum(at + k, len(flat) - 1)
        alive &= ~gap[there]
        code = code << np.uint64(16) | np.where(alive, flat[there], 0).astype(np.uint64)
    code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code ^ code >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    code = (code ^ code >> np.uint64(31)) % np.uint64((1 << BITS - 1) - 1) + np.uint64(1)
    code = code << np.uint64(1) | (at == begin[at]).astype(np.uint64)
    sizes = np.array([len(own) + 1 for own in units], dtype=np.int64)
    return code, np.repeat(np.arange(len(texts)), sizes)[at] if texts else np.zeros(0, np.int64)


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys of all pieces of several texts, and the text each belongs to."""
    code, owner = codes(texts)
    keys = code.copy()
    for back in range(1, ORDER):
        before = np.full(len(code), START, dtype=np.uint64)
        same = owner[back:] == owner[:-back]
        before[back:][same] = code[:-back][same]
        keys |= before << np.uint64(BITS * back)
    return keys, owner


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, gram, n)`` over all texts; a task holds some ``HELD`` keys at most."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str | None, list] = {}
        size = 0

        def flush() -> Iterator[dict]:
            for lang, parts in held.items():
                keys, n = _merge(parts)
                for a in range(0, len(keys), FLUSH):
                    some = keys[a : a + FLUSH]
                    yield {"lang": [lang] * len(some), "gram": some.view(np.int64), "n": n[a : a + FLUSH]}

        for batch in batches:
            by: dict[str | None, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append((text or "").encode("utf-8", "surrogatepass").split())
            for lang, texts in by.items():
                keys, n = np.unique(grams(texts)[0], return_counts=True)
                if len(keys):
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
            if size > HELD:
                held = {lang: [_merge(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    found = map_batches(docs.select(lang_col, text_col), step, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _mask(pieces: int) -> int:
    return (1 << (BITS * pieces)) - 1


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of a language from its counts of counts.

    Where a count of counts is zero, the discount takes the usual 0.5, 1 or 1.5.
    """
    n = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))  # Spark may divide before it looks at the condition

    def discount(i: int, default: float):
        value = i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}")
        return F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0) & (value > 0), value).otherwise(default).alias(f"d{i}")

    return counts.groupBy("lang").agg(*n).select(F.col("lang").alias("__lang"), discount(1, 0.5), discount(2, 1.0), discount(3, 1.5))


def _weights(rows: DataFrame) -> DataFrame:
    """``(__slang, __sctx, total, kinds, gamma, d1, d2, d3)`` of every context: ``gamma`` is what it leaves to the order below."""
    stats = rows.groupBy(F.col("lang").alias("__slang"), F.col("__ctx").alias("__sctx")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"),
        *[F.sum((F.col("n") == i).cast("long")).alias(f"u{i}") for i in (1, 2)], F.sum((F.col("n") > 2).cast("long")).alias("u3"),
    )
    gamma = (F.col("d1") * F.col("u1") + F.col("d2") * F.col("u2") + F.col("d3") * F.col("u3")) / F.col("total")
    own = stats.join(_discounts(rows), F.col("__slang").eqNullSafe(F.col("__lang")))
    return own.select("__slang", "__sctx", "total", "kinds", gamma.alias("gamma"), "d1", "d2", "d3")


def _interpolated(rows: DataFrame, weights: DataFrame, lower: DataFrame | None, k: int) -> DataFrame:
    """``(lang, key, p)`` of the keys of order ``k``; ``lower`` has the order below."""
    joined = rows.join(weights, F.col("lang").eqNullSafe(F.col("__slang")) & (F.col("__ctx") == F.col("__sctx")))
    if lower is None:
        below = 1 / (F.col("kinds") + 1)  # one place for any unit not seen
    else:
        part = lower.select(F.col("lang").alias("__llang"), F.col("key").alias("__lkey"), F.col("p").alias("__below"))
        suffix = F.col("key").bitwiseAND(F.lit(_mask(k - 1)))
        joined = joined.join(part, F.col("lang").eqNullSafe(F.col("__llang")) & (suffix == F.col("__lkey")))
        below = F.col("__below")
    discount = F.when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    seen = F.when(F.col("n") > 1, (F.col("n") - discount) / F.col("total")).otherwise(0.0)
    return joined.select("lang", "key", (seen + F.col("gamma") * below).alias("p"))


def _orders(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the highest order, the weights of its contexts, and the probabilities one order below.

    Lower orders count the distinct units in front (continuation counts), as the method asks.
    """
    levels = {ORDER: counts.select("lang", F.col("gram").alias("key"), "n")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit(_mask(k)))
        levels[k] = materialise(levels[k + 1].groupBy("lang", suffix.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    lower = None
    for k in range(1, ORDER + 1):
        context = F.shiftrightunsigned("key", BITS) if k > 1 else F.lit(0).cast("long")
        rows = levels[k].withColumn("__ctx", context)
        weights = _weights(rows)
        if k < ORDER:
            lower = materialise(_interpolated(rows, weights, lower, k))
    return rows, materialise(weights), lower


def _free(counts: DataFrame) -> DataFrame:
    """``(__lang, __last, __free)``: bits of each piece that begins words, as one of all word beginnings in no order."""
    last = F.col("gram").bitwiseAND(F.lit(_mask(1)))
    begins = materialise(
        counts.where(F.col("gram").bitwiseAND(F.lit(1)) == 1).groupBy(F.col("lang").alias("__lang"), last.alias("__last")).agg(F.sum("n").alias("__n"))
    )
    words = begins.groupBy(F.col("__lang").alias("__wlang")).agg(F.sum("__n").alias("__words"))
    return begins.join(words, F.col("__lang").eqNullSafe(F.col("__wlang"))).select("__lang", "__last", F.log2(F.col("__words") / F.col("__n")).alias("__free"))


def gram_bits(counts: DataFrame) -> DataFrame:
    """``(lang, gram, bits, gain)``: minus log2 of the interpolated probability of each counted key's last piece.

    ``gain`` is what the pieces in front save at a piece that begins a word: its bits as one
    of all word beginnings, whatever their order, less ``bits``; 0 at other pieces.

    ``counts`` is read several times (``materialise`` it).
    """
    last = F.col("gram").bitwiseAND(F.lit(_mask(1)))
    model = _interpolated(*_orders(counts), ORDER).select("lang", F.col("key").alias("gram"), (-F.log2("p")).alias("bits"))
    return model.join(_free(counts), F.col("lang").eqNullSafe(F.col("__lang")) & (last == F.col("__last")), "left").select(
        "lang", "gram", "bits", F.coalesce(F.col("__free") - F.col("bits"), F.lit(0.0)).alias("gain")
    )


def gram_parts(counts: DataFrame) -> DataFrame:
    """The same model, ``(lang, part, key, bits)``, without the keys counted once.

    Such a key has no probability of its own: its bits are those its context leaves to the
    order below (``CONTEXT``) plus those of its last two pieces (``PAIR``). ``TRIPLE`` are
    the keys counted more than once, ``BEGIN`` the pieces that begin words, in no order.
    """
    rows, weights, lower = _orders(counts)
    parts = {
        TRIPLE: _interpolated(rows.where(F.col("n") > 1), weights, lower, ORDER).select("lang", "key", (-F.log2("p")).alias("bits")),
        PAIR: lower.select("lang", "key", (-F.log2("p")).alias("bits")),
        CONTEXT: weights.select(F.col("__slang").alias("lang"), F.col("__sctx").alias("key"), (-F.log2("gamma")).alias("bits")),
        BEGIN: _free(counts).toDF("lang", "key", "bits"),
    }
    return reduce(DataFrame.unionByName, [own.select("lang", F.lit(part).alias("part"), "key", "bits") for part, own in parts.items()])


def sorted_arrays(model: DataFrame) -> DataFrame:
    """The model as stored: rows ``(lang, part, shard, keys, bits)`` with both arrays sorted by key.

    A shard is a range of keys with the same leading seven bits, so shards in order make one sorted array.
    """
    shard = F.coalesce(*[F.when(F.col("part") == part, F.shiftrightunsigned("key", BITS * pieces - 7)) for part, pieces in PIECES.items()])
    pairs = F.array_sort(F.collect_list(F.struct("key", F.col("bits").cast("float").alias("bits"))))
    return model.groupBy("lang", "part", shard.alias("shard")).agg(pairs.alias("__pairs")).select(
        "lang", "part", "shard", F.col("__pairs.key").alias("keys"), F.col("__pairs.bits").alias("bits")
    )


def model_arrays(model: DataFrame) -> dict[str | None, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Sorted keys and their bits by language and part."""
    found: dict[str | None, dict[int, dict]] = {}
    for batch in sorted_arrays(model).toArrow().to_batches():
        for lang, part, shard, keys, bits in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
            found.setdefault(lang, {}).setdefault(part, {})[shard] = keys.values.to_numpy().view(np.uint64), bits.values.to_numpy()
    return {
        lang: {part: tuple(map(np.concatenate, zip(*[own[i] for i in sorted(own)], strict=True))) for part, own in parts.items()}
        for lang, parts in found.items()
    }


def key_bits(parts: dict[int, tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and order gain of counted keys of one language."""

    def of(part: int, wanted: np.ndarray) -> np.ndarray:
        known, bits = parts[part]
        return bits[np.searchsorted(known, wanted)]

    bits = np.zeros(len(keys), dtype=np.float32)
    own = np.zeros(len(keys), dtype=bool)
    if TRIPLE in parts:
        known, values = parts[TRIPLE]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        own = known[at] == keys
        bits[own] = values[at[own]]
    once = keys[~own]
    bits[~own] = of(CONTEXT, once >> np.uint64(BITS)) + of(PAIR, once & np.uint64(_mask(2)))
    gain = np.zeros(len(keys), dtype=np.float32)
    begins = (keys & np.uint64(1)).astype(bool)
    if begins.any():
        gain[begins] = of(BEGIN, keys[begins] & np.uint64(_mask(1))) - bits[begins]
    return bits, gain


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends])[:n].tolist()
    line = b" ".join(words)
    found = [line[a:b] for a, b in zip(begins, (ends[window - 1 :] - 1).tolist(), strict=True)]
    if len(set(found)) == n:
        return 0
    times = Counter(found)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    twice = np.flatnonzero([times[f] > 1 for f in found])
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def rule_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    white = text.count(" ") + sum(text.count(c) for c in "\t\n\x0b\x0c\r")
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(words), len(text) - white, len(text) - len(text.translate(SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def spoken(words: list[bytes]) -> int:
    """Words with a character other than ASCII punctuation, at least 1."""
    return max(1, len(b" ".join(words).translate(None, PUNCTUATION).split()))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _scored(docs: DataFrame, model: DataFrame, broadcast: bool, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """Counts of each text, its spoken words and the bits of all its units."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, lang_col, text_col)
    base = f"`{id_col}` {kind}, lang string, {COUNTS}, spoken long"

    def read(batch: pa.RecordBatch) -> tuple[dict, list, list]:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        counts = np.array([rule_counts(t, w) for t, w in zip(texts, words, strict=True)], dtype=np.int64).reshape(-1, 5)
        langs = batch.column(1).to_pylist()
        by: dict[str | None, list[int]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(i)
        out = {"id": batch.column(0), "lang": langs, **{str(i): counts[:, i] for i in range(5)}, "spoken": [spoken(w) for w in words]}
        return out, words, list(by.items())

    if broadcast:
        shared = docs.sparkSession.sparkContext.broadcast(model_arrays(model))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                out, words, by = read(batch)
                sums = np.zeros((2, batch.num_rows))
                for lang, rows_ in by:
                    keys, owner = grams([words[i] for i in rows_])
                    if len(keys):
                        own, where = np.unique(keys, return_inverse=True)
                        for kind_, cost in enumerate(key_bits(shared.value[lang], own)):
                            sums[kind_, rows_] = np.bincount(owner, weights=cost[where], minlength=len(rows_))
                yield out | {"bits": sums[0], "gain": sums[1]}

        return map_batches(rows, score, f"{base}, bits double, gain double")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out, words, _ = read(batch)
            keys, owner = grams(words)
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]).astype(bool) | (np.diff(owner, prepend=-1) > 0))
            n = np.diff(first, append=len(keys))
            pairs = pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(n)], names=["gram", "n"])
            ends = np.searchsorted(owner[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield out | {"row": row + np.arange(batch.num_rows), "keys": pa.ListArray.from_arrays(pa.array(ends), pairs)}
            row += batch.num_rows

    asked = materialise(map_batches(rows, ask, f"{base}, __row long, __keys array<struct<gram: long, n: long>>"))
    wanted = asked.select("__row", F.col("lang").alias("__lang"), F.explode("__keys").alias("k")).select(
        "__row", "__lang", F.col("k.gram").alias("__gram"), F.col("k.n").alias("__n")
    )
    found = wanted.join(model, F.col("__lang").eqNullSafe(model["lang"]) & (F.col("__gram") == F.col("gram")))
    costs = ("bits", "gain")
    sums = found.groupBy("__row").agg(*[F.sum(F.col("__n") * F.col(c).cast("float")).alias(c) for c in costs])
    return asked.join(sums, "__row", "left").select(
        *[c for c in asked.columns if not c.startswith("__")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in costs]
    )


def bands(scored: DataFrame, measures: tuple[str, ...] = ("__mean", "__gain")) -> DataFrame:
    """``(__lang, <measure>_mid, <measure>_down, <measure>_up)`` of values in whole steps, by language.

    Exact median of each measure, and for each side the median distance of the values on that
    side (x 1.4826, in bits), so that a long tail of one side widens that side only.
    """
    each = F.array(*[F.struct(F.lit(name).alias("__measure"), F.col(name).alias("__v")) for name in measures])
    values = scored.select("lang", F.explode(each).alias("__e")).select("lang", "__e.*")
    hist = materialise(values.groupBy("lang", "__measure", "__v").agg(F.count(F.lit(1)).alias("__n")))
    middle = materialise(_median(hist, "lang", "__measure"))
    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("__side")
    away = _matched(hist, middle, "lang", "__measure").select("lang", "__measure", "__n", F.col("__v") - F.col("__m"), sides).toDF(
        "lang", "__measure", "__n", "__v", "__side"
    ).withColumn("__v", F.col("__side") * F.col("__v")).where(F.col("__v") >= 0)
    spread = _median(away, "lang", "__measure", "__side").withColumn("__m", F.greatest(F.lit(LEAST), F.lit(1.4826) * F.col("__m") / STEPS))
    found = middle.select("lang", "__measure", F.lit(0).alias("__side"), (F.col("__m") / STEPS).alias("__m")).unionByName(spread)
    names = {0: "mid", -1: "down", 1: "up"}
    return found.groupBy(F.col("lang").alias("__lang")).agg(*[
        F.max(F.when((F.col("__measure") == name) & (F.col("__side") == side), F.col("__m"))).alias(f"{name}_{word}")
        for name in measures for side, word in names.items()
    ])


def _matched(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Inner join on equal keys, null with null; ``rows``' keys stay."""
    own = other.select(*[F.col(k).alias(f"{k}__o") if k in keys else F.col(k) for k in other.columns])
    on = [F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in keys]
    return rows.join(own, on).drop(*[f"{k}__o" for k in keys])


def _median(values: DataFrame, *keys: str) -> DataFrame:
    """``(keys, __m)``: the lower median of ``__v`` with ``__n`` copies each: its coarse cell first, then its step."""
    cells = values.groupBy(*keys, F.floor(F.col("__v") / CELL).alias("__cell")).agg(F.sum("__n").alias("__c"))
    along = Window.partitionBy(*keys).orderBy("__cell")
    marked = cells.withColumns({"__up": F.sum("__c").over(along), "__all": F.sum("__c").over(Window.partitionBy(*keys))})
    before = F.col("__up") - F.col("__c")
    first = marked.where((2 * F.col("__up") >= F.col("__all")) & (2 * before < F.col("__all"))).select(
        *keys, F.col("__cell").alias("__at"), before.alias("__before"), "__all"
    )
    inside = _matched(values, first, *keys).where(F.floor(F.col("__v") / CELL) == F.col("__at"))
    steps = inside.groupBy(*keys, "__v", "__before", "__all").agg(F.sum("__n").alias("__n"))
    steps = steps.withColumn("__up", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys).orderBy("__v")))
    return steps.where(2 * F.col("__up") >= F.col("__all")).groupBy(*keys).agg(F.min("__v").alias("__m"))


def judge(
    docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
    widths: tuple[float, float, float] = (LOWER, UPPER, ORDERED), broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """Counts, perplexity, order gain, limits and verdict of every text.

    ``(id, lang, counts, base_failed, perplexity, lower, upper, gain, least_gain, kept)``; ``gain`` is in bits per word.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        counts = materialise(count_grams(docs, lang_col, text_col))
    broadcast = counts.where(F.col("n") > 1).count() <= broadcast_entries
    model = gram_parts(counts) if broadcast else materialise(gram_bits(counts))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        scored = materialise(_scored(docs, model, broadcast, id_col, lang_col, text_col))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    mean, gain = F.col("bits") / F.col("spoken"), F.col("gain") / F.greatest("n_words", F.lit(1))
    scored = scored.withColumns({"base_failed": failed, "__bits": mean, "__order": gain})
    steps = {"__mean": F.round(F.col("__bits") * STEPS).cast("long"), "__gain": F.round(F.col("__order") * STEPS).cast("long")}
    limits = bands(scored.where(~F.col("base_failed")).withColumns(steps))
    wider = F.sqrt(1 + F.lit(SHORT) / F.col("spoken"))
    low, high, ordered = widths
    lower = F.col("__mean_mid") - low * F.col("__mean_down") * wider
    upper = F.col("__mean_mid") + high * F.col("__mean_up") * wider
    least = F.col("__gain_mid") - ordered * F.col("__gain_down") * wider
    inside = F.col("__bits").between(lower, upper) & (F.col("__order") >= least)
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left").select(
        id_col, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.pow(F.lit(2.0), "__bits").alias("perplexity"), F.pow(F.lit(2.0), lower).alias("lower"),
        F.pow(F.lit(2.0), upper).alias("upper"), F.col("__order").alias("gain"), least.alias("least_gain"),
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, as they are."""
    own = keyed(docs, id_col, text_col, lang_col)
    rejected = judge(own, "__key", lang_col, text_col).where(~F.col("kept"))
    return without(own, rejected)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict on every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round(F.log2("perplexity"), 6).alias("bits_per_word"), F.round("gain", 6).alias("order_gain"),
    )
