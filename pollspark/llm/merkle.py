"""Merkle fingerprints of texts, by built-in functions only.

A text splits into paragraphs at line feeds, a paragraph into leaves of up to four
words that end early after a sentence (white space stays in the leaves, so they
cover the text). A paragraph node hashes its leaves. A section is a run of
paragraphs that ends after a paragraph whose hash starts with 0 or 1, so section
borders move with the text and not with positions. The root hashes the sections.

A fingerprint is ``root:body``. Equal roots mean equal texts. The body has the first
``SHORT`` hex digits of every leaf hash, paragraphs closed by "," and sections by
";": it is the tree written out, and a section's or paragraph's string stands for its
node. Two fingerprints alone tell how alike the texts are (``likeness``, over leaves
and roots) and where they differ (``differing``, section by section, then paragraph by
paragraph). Unlike leaves share their digits once in ``16 ** SHORT`` pairs.

Cases: a null text is an empty one (one paragraph without leaves); a document alone
in its table is its own next one; rows equal in id and text share one place in the
order; a null id is the smallest; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm.common import table, texts
from pollspark.operators.ranking import row_numbers
from pollspark.session import materialise

SHORT = 6
_S, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Up to three words that end no sentence, a last word, the white space around; or white space alone.
LEAF = rf"{_S}*(?:{_W}*[^\x20\x09-\x0D.!?]{_S}+){{0,3}}{_W}+{_S}*|{_S}+"


def fingerprint(text: Column) -> Column:
    """``root:body`` of a text without nulls."""
    leaves = F.transform(
        F.split(text, "\n"),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.md5(leaf)),
    )
    paragraphs = F.transform(
        leaves,
        lambda ls: F.struct(
            F.md5(F.array_join(ls, "")).alias("hash"),
            F.array_join(F.transform(ls, lambda h: F.substring(h, 1, SHORT)), "").alias("short"),
        ),
    )
    closed = F.transform(
        paragraphs,
        lambda p: F.struct(
            p["hash"].alias("hash"), p["short"].alias("short"),
            F.when(F.substring(p["hash"], 1, 1).isin("0", "1"), ";").otherwise(",").alias("end"),
        ),
    )
    # One array is read twice, so it goes through a one-element transform that names it.
    return F.element_at(
        F.transform(
            F.array(closed),
            lambda ps: F.concat(
                F.md5(
                    F.array_join(
                        F.transform(
                            F.split(F.array_join(F.transform(ps, lambda p: F.concat(p["hash"], p["end"])), ""), ";"),
                            lambda section: F.md5(section),
                        ),
                        "",
                    )
                ),
                F.lit(":"),
                F.array_join(F.transform(ps, lambda p: F.concat(p["short"], p["end"])), ""),
            ),
        ),
        1,
    )


def _body(print_: Column) -> Column:
    return F.substring_index(print_, ":", -1)


def _counted_leaves(print_: Column) -> Column:
    """The leaves of a fingerprint, each with its number among the equal ones, so that sets of them count."""
    leaf = rf"[0-9a-f]{{{SHORT}}}"
    sorted_ = F.array_join(F.array_sort(F.regexp_extract_all(_body(print_), F.lit(leaf), F.lit(0))), "")
    runs = F.regexp_extract_all(sorted_, F.lit(rf"({leaf})\1*"), F.lit(0))
    return F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(
                F.sequence(F.lit(1), (F.length(run) / SHORT).cast("int")), lambda k: F.concat(F.substring(run, 1, SHORT), k.cast("string"))
            ),
        )
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the leaves and roots of two fingerprints, 0 to 1 (twice the common over the sum).

    A leaf counts as often as it occurs in both. Unequal roots are not shared, so 1
    means equal texts and nothing else.
    """
    pair = F.transform(F.array(F.struct(_counted_leaves(a).alias("a"), _counted_leaves(b).alias("b"))), lambda s: F.struct(
        F.size(F.array_intersect(s["a"], s["b"])).alias("both"), (F.size(s["a"]) + F.size(s["b"]) + 2).alias("all")
    ))
    shared = F.element_at(F.transform(pair, lambda c: 2.0 * c["both"] / c["all"]), 1)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(shared)


def _apart(a: Column, b: Column) -> Column:
    """``(head, tail)``: how many leading and how many further trailing entries two arrays share."""

    def leading(x: Column, y: Column) -> Column:
        same = F.transform(F.zip_with(x, y, lambda p, q: p == q), lambda e: F.coalesce(e, F.lit(False)))
        first = F.array_position(same, F.lit(False)).cast("int")
        return F.when(first > 0, first - 1).otherwise(F.size(same))

    head = leading(a, b)
    tail = F.least(leading(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - head)
    return F.struct(head.alias("head"), tail.alias("tail"))


def _named(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _middle(x: Column, cut: Column) -> Column:
    return F.slice(x, cut["head"] + 1, F.size(x) - cut["head"] - cut["tail"])


def differing(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs of ``a`` that differ from those of ``b``.

    Sections that both texts share at the start and at the end are passed over unseen, then
    the shared paragraphs at both ends of what is left. Of the rest those paragraphs are
    reported that ``b`` has less often; if it has them all, they only stand elsewhere
    (moved, or another one was put between them) and all are reported.
    """
    def sections(x: Column) -> Column:
        return F.regexp_extract_all(_body(x), F.lit("[^;]*;|[^;]+$"), F.lit(0))

    def paragraphs(part: Column) -> Column:
        return F.regexp_extract_all(F.array_join(part, ""), F.lit("([^,;]*)[,;]"), F.lit(1))

    def located(d: Column) -> Column:
        x, y, before = d["x"], d["y"], d["before"]

        def inside(cut: Column) -> Column:
            return _named(
                F.struct(_middle(x, cut).alias("own"), _middle(y, cut).alias("other"), (before + cut["head"]).alias("from")), compare
            )

        return _named(_apart(x, y), inside)

    def compare(m: Column) -> Column:
        own, other = m["own"], m["other"]
        places = F.transform(own, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        lacking = F.filter(
            places,
            lambda e: F.size(F.filter(F.slice(own, F.lit(1), e["i"] + 1), lambda q: q == e["p"])) > F.size(F.filter(other, lambda q: q == e["p"])),
        )
        return _named(
            F.struct(lacking.alias("lacking"), places.alias("all"), m["from"].alias("from")),
            lambda r: F.transform(F.when(F.size(r["lacking"]) > 0, r["lacking"]).otherwise(r["all"]), lambda e: e["i"] + r["from"]),
        )

    def descend(s: Column) -> Column:
        return _named(
            _apart(s["a"], s["b"]),
            lambda cut: _named(
                F.struct(
                    paragraphs(_middle(s["a"], cut)).alias("x"), paragraphs(_middle(s["b"], cut)).alias("y"),
                    F.size(paragraphs(F.slice(s["a"], F.lit(1), cut["head"]))).alias("before"),
                ),
                located,
            ),
        )

    return _named(F.struct(sections(a).alias("a"), sections(b).alias("b")), descend)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every text."""
    return texts(docs, text_col, id_col).select(id_col, fingerprint(F.col(text_col)).alias("fingerprint"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, the text with its last third exchanged for the start of the next document's, and the fingerprints.

    ``(id, n_chars, text, edited, fingerprint, edited_fingerprint, next_fingerprint)``.
    Next means descending ids, after the last the first. The order is found on ids
    and lengths alone; the texts are shuffled once, by id, and each document sends
    its predecessor only the prefix that this one takes.
    """
    base = texts(docs, text_col, id_col).select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__hash")
    )
    light = base.groupBy("__id", "__hash", F.char_length("__text").alias("__n")).agg(F.count(F.lit(1)).alias("__rows"))
    ranks = materialise(row_numbers(light, [F.col("__id"), F.col("__hash"), F.col("__n")], "__rank"))
    total, most = ranks.agg(F.count(F.lit(1)), F.max("__rows")).first()
    takers = ranks.select(
        (F.pmod(F.col("__rank") - 2, F.lit(max(total, 1))) + 1).alias("__rank"),
        F.col("__id").alias("__to_id"), F.col("__hash").alias("__to_hash"), F.floor(F.col("__n") / 3).cast("int").alias("__k"),
    )
    wanted = ranks.join(takers, "__rank").select(
        F.col("__id").alias("__from_id"), F.col("__hash").alias("__from_hash"), "__to_id", "__to_hash", "__k"
    )
    heads = base.join(wanted, F.col("__id").eqNullSafe(F.col("__from_id")) & (F.col("__hash") == F.col("__from_hash"))).select(
        "__to_id", "__to_hash", F.substring(F.col("__text"), F.lit(1), F.col("__k")).alias("__head"),
        fingerprint(F.col("__text")).alias("next_fingerprint"),
    )
    if (most or 0) > 1:
        heads = heads.dropDuplicates(["__to_id", "__to_hash"])
    n = F.char_length("__text")
    kept = F.substring(F.col("__text"), F.lit(1), (n - F.floor(n / 3)).cast("int"))
    joined = base.join(heads, F.col("__id").eqNullSafe(F.col("__to_id")) & (F.col("__hash") == F.col("__to_hash"))).select(
        F.col("__id").alias(id_col), n.cast("long").alias("n_chars"), F.col("__text").alias("text"),
        F.concat(kept, "__head").alias("edited"), "next_fingerprint",
    )
    return joined.withColumns(
        {"fingerprint": fingerprint(F.col("text")), "edited_fingerprint": fingerprint(F.col("edited"))}
    )


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    found = edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _sql_fingerprint(text: str) -> str:
    leaf = LEAF.replace("'", "''")
    return f"""list_transform([list_transform(list_transform(string_split({text}, chr(10)),
        lambda p: list_transform(regexp_extract_all(p, '{leaf}'), lambda x: md5(x))),
        lambda ls: {{'hash': md5(list_aggregate(list_append(ls, ''), 'string_agg', '')),
                'short': list_aggregate(list_append(list_transform(ls, lambda h: h[1:{SHORT}]), ''), 'string_agg', '')}})],
      lambda ps: md5(list_aggregate(list_transform(string_split(list_aggregate(list_transform(ps, lambda p: p.hash
              || CASE WHEN p.hash[1] IN ('0', '1') THEN ';' ELSE ',' END), 'string_agg', ''), ';'), lambda s: md5(s)), 'string_agg', ''))
          || ':' || list_aggregate(list_transform(ps, lambda p: p.short
              || CASE WHEN p.hash[1] IN ('0', '1') THEN ';' ELSE ',' END), 'string_agg', ''))[1]"""


def _sql_likeness(a: str, b: str) -> str:
    def leaves(x: str) -> str:
        return f"regexp_extract_all(split_part({x}, ':', 2), '[0-9a-f]{{{SHORT}}}')"

    def times(of: str) -> str:
        return f"len(list_filter({leaves(of)}, lambda y: y = h))"

    total = f"(len({leaves(a)}) + len({leaves(b)}) + 2)"
    shared = f"coalesce(list_sum(list_transform(list_distinct({leaves(a)}), lambda h: least({times(a)}, {times(b)}))), 0)"
    return f"""CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0E0 ELSE 2.0E0 * {shared} / {total} END"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id DESC),
             first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next
      FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next, 1, n_chars // 3) AS edited FROM n),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_sql_fingerprint("text")} AS fingerprint,
             {_sql_fingerprint("edited")} AS edited_fingerprint, {_sql_fingerprint("next")} AS next_fingerprint FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_sql_likeness("fingerprint", "edited_fingerprint")} AS near_edited,
       {_sql_likeness("fingerprint", "next_fingerprint")} AS near_next
FROM f"""
