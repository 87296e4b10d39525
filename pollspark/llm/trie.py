"""Prefix trie of conversations that share openings, by composable fingerprints.

A conversation is rebuilt from the head of a base conversation and its own later turns.
The fingerprint of a sequence of turns is an element of a monoid: the pair (hash,
power), where (h, q) * (g, r) = (h * r + g, q * r) modulo two primes. One ordered scan
gives the product of every opening of the original conversations; the product of a
rebuilt opening follows from those of the base's head and of the own turns by
arithmetic on columns, so no rebuilt text is ever put together. A node is a depth and a
fingerprint; it stores a reference (conversation, place) to the turn that is its last.

Exact equality: turns enter by a 64-bit hash of role and text, and it is checked that no
two different turns of the table share one. A group's members are then checked to
agree in the hash of their last turn; as the parent's fingerprint follows from the
fingerprint and that hash, agreement at every depth makes the sequences equal. If a
check fails, all is done again with the next seed.

Sums over subtrees are taken in rounds that double the distance between a node and the
ancestor it sends to, so their number is the logarithm of the longest conversation.

Cases: a null conversation id belongs to no conversation, such rows take no part; null
role or text is empty; turns are ordered with null first, rows of equal turn by role and
text; repeated rows are turns of their own; a conversation without turns left ends at the
root; an empty table gives no rows, not even a root. A very long conversation is
split over partitions in every step. A node's digest is a hash over a sequence: its ids
are joined to long pieces in order, and only the pieces pass through one task, one at
a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm.common import crc32_sql, map_batches, table
from pollspark.session import materialise

#: Conversations of one run of so many ids share their base.
FAMILY = 20
#: Heads have fewer turns than this.
HEADS = 4
#: Two primes below 2 ** 31 and a base of each, so that products fit a long.
PRIMES = (2147483647, 2147483629)
BASES = (1102195331, 1671303913)
#: Turns of a conversation that share one row of its constants.
STRETCH = 1 << 12
#: Ids joined to one piece of a digest's text.
PIECE = 1 << 14
ROUNDS = 5
LANES = range(len(PRIMES))


class Collision(Exception):
    """Two different things have one hash."""


def _mod(x: Column, lane: int) -> Column:
    return F.pmod(x, F.lit(PRIMES[lane]))


def turn_rows(conversations: DataFrame, seed: int) -> DataFrame:
    """``(conv_id, turn, role, text, token, words)``; ``token`` is checked to name role and text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    rows = rows.withColumn("token", F.xxhash64(F.lit(seed), "role", "text"))
    shared = rows.select("token", "role", "text").distinct().groupBy("token").count().where("count > 1")
    if not shared.isEmpty():
        raise Collision("turns")
    return rows.withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))


def lanes_of(token: Column) -> list[Column]:
    """A turn's element in each lane."""
    return [_mod(F.shiftrightunsigned(token, 31 * lane), lane) for lane in LANES]


def openings(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, token, words, h0, h1, q0, q1)``: every turn with the product of the turns up to it.

    Rows are dealt by range, so a long conversation lies in several partitions; each is
    scanned on its own, and the products of the parts before are multiplied in.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = sorted_.select("conv_id", "token", "words", *[x.alias(f"t{i}") for i, x in enumerate(lanes_of(F.col("token")))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        conv, pos, h, q = None, 0, [0, 0], [1, 1]
        for batch in batches:
            ids = batch.column(0)
            out = [[] for _ in range(5)]
            for key, *t in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if key != conv:
                    conv, pos, h, q = key, 0, [0, 0], [1, 1]
                pos += 1
                h = [(h[i] * BASES[i] + t[i]) % PRIMES[i] for i in LANES]
                q = [q[i] * BASES[i] % PRIMES[i] for i in LANES]
                for column, x in zip(out, (pos, *h, *q), strict=True):
                    column.append(x)
            yield {"conv_id": ids, "part": [part] * len(ids), "token": batch.column(1), "words": batch.column(2),
                   **dict(zip(("pos", "h0", "h1", "q0", "q1"), out, strict=True))}

    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, token long, words long, pos long, h0 long, h1 long, q0 long, q1 long"
    local = materialise(map_batches(narrow, scan, schema, rows=1 << 13))
    last = [F.max_by(F.struct("pos", "h0", "h1", "q0", "q1"), "pos").alias("last")]
    runs = local.groupBy("conv_id", "part").agg(*last)
    # A part is in this table at most twice, with the run that it opens with and the one that it ends with.
    several = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "last"))).alias("runs")).where(F.size("runs") > 1)

    def product(a: Column, b: Column) -> Column:
        return F.struct(
            (a["pos"] + b["pos"]).alias("pos"),
            *[_mod(a[f"h{i}"] * b[f"q{i}"] + b[f"h{i}"], i).alias(f"h{i}") for i in LANES],
            *[_mod(a[f"q{i}"] * b[f"q{i}"], i).alias(f"q{i}") for i in LANES],
        )

    one = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("pos", 0), ("h0", 0), ("h1", 0), ("q0", 1), ("q1", 1))])
    before = several.select("conv_id", F.posexplode("runs").alias("at", "run"), "runs").select(
        "conv_id", F.col("run.part").alias("part"),
        F.aggregate(F.slice("runs", F.lit(1), F.col("at")), one, lambda a, r: product(a, r["last"])).alias("before"),
    )
    joined = local.join(materialise(before), ["conv_id", "part"], "left")
    whole = product(F.coalesce("before", one), F.struct("pos", "h0", "h1", "q0", "q1"))
    return joined.withColumn("whole", whole).select("conv_id", "token", "words", "whole.*")


def plans(opened: DataFrame) -> DataFrame:
    """How each conversation is rebuilt, one row each.

    ``own`` (turns that it had), ``skip`` (of them left out), ``base``, ``head`` (the
    base's turns taken, an array), ``taken`` (their number), ``length``, and ``a0``,
    ``a1``: what the head's product adds to that of the own turns.
    """
    at = [F.max(F.when(F.col("pos") == i, F.struct("pos", "token", "words", "h0", "h1"))) for i in range(1, HEADS)]
    convs = materialise(opened.groupBy("conv_id").agg(F.max("pos").alias("own"), F.array_compact(F.array(*at)).alias("first")))
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    family = F.pmod(F.col("conv_id"), F.lit(FAMILY))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    rows = convs.withColumn("skip", asked).withColumn("base", F.col("conv_id") - family).join(bases, "base", "left")
    none = F.array().cast(convs.schema["first"].dataType)
    rows = rows.withColumn("head", F.slice(F.coalesce("base_first", none), F.lit(1), F.col("skip").cast("int")))
    rows = rows.withColumn("taken", F.size("head").cast("long"))

    def end(heads: str, n: str, lane: int) -> Column:
        return F.coalesce(F.try_element_at(heads, F.col(n).cast("int"))[f"h{lane}"], F.lit(0).cast("long"))

    safe = F.when(F.col("skip") > 0, F.col("skip"))  # element 0 does not exist
    return rows.withColumn("__skip", safe).withColumn("__taken", F.when(F.col("taken") > 0, F.col("taken"))).select(
        "conv_id", "own", "skip", "base", "head", "taken",
        (F.col("taken") + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).alias("length"),
        *[_mod(end("head", "__taken", i) - end("first", "__skip", i), i).alias(f"a{i}") for i in LANES],
    )


def members(opened: DataFrame, planned: DataFrame) -> DataFrame:
    """``(conv_id, depth, f0, f1, token, words, ref_conv, ref_pos, last)``: every opening of every rebuilt conversation."""
    heads = planned.select("conv_id", "base", "length", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), F.col("t.h0").alias("f0"), F.col("t.h1").alias("f1"),
        F.col("t.token").alias("token"), F.col("t.words").alias("words"),
        F.col("base").alias("ref_conv"), F.col("t.pos").alias("ref_pos"), (F.col("t.pos") == F.col("length")).alias("last"),
    )
    # Constants stand once for each stretch of turns, so a long conversation is no single key.
    kept = planned.where(F.col("own") > F.col("skip")).select(
        "conv_id", "skip", "taken", "length", "a0", "a1", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(own - 1) div {STRETCH}"))).alias("stretch")
    )
    own = opened.withColumn("stretch", F.expr(f"(pos - 1) div {STRETCH}")).join(kept, ["conv_id", "stretch"]).where("pos > skip")
    # The power of the own turns is that of all turns without the ones left out.
    back = [[pow(b, -n, p) for n in range(HEADS)] for b, p in zip(BASES, PRIMES, strict=True)]
    f = []
    for i in LANES:
        undo = F.element_at(F.array(*[F.lit(x).cast("long") for x in back[i]]), (F.col("skip") + 1).cast("int"))
        f.append(_mod(F.col(f"a{i}") * _mod(F.col(f"q{i}") * undo, i) + F.col(f"h{i}"), i).alias(f"f{i}"))
    depth = F.col("taken") + F.col("pos") - F.col("skip")
    tails = own.select(
        "conv_id", depth.alias("depth"), *f, "token", "words", F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"),
        (depth == F.col("length")).alias("last"),
    )
    return heads.unionByName(tails)


def node_rows(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``(depth, f, parent, conv_id, n_convs, words, ref_conv, ref_pos)``: one row a node; ``f`` joins both lanes."""
    agree = (F.min("token") == F.max("token")) & (F.min("words") == F.max("words"))
    least = F.min(F.struct("conv_id", "ref_conv", "ref_pos"))
    groups = materialise(
        rows.groupBy("depth", "f0", "f1").agg(
            least.alias("least"), F.count(F.lit(1)).alias("n_convs"), F.max("token").alias("token"), F.max("words").alias("words"),
            agree.alias("agree"),
        )
    )
    if not groups.where(~F.col("agree")).isEmpty():
        raise Collision("openings")
    up = []
    for i, t in enumerate(lanes_of(F.col("token"))):
        back = F.lit(pow(BASES[i], -1, PRIMES[i]))
        up.append(_mod(_mod(F.col(f"f{i}") - t, i) * back, i))
    nodes = groups.select(
        "depth", _joined(F.col("f0"), F.col("f1")).alias("f"), _joined(*up).alias("parent"), F.col("least.conv_id").alias("conv_id"),
        "n_convs", "words", F.col("least.ref_conv").alias("ref_conv"), F.col("least.ref_pos").alias("ref_pos"),
    )
    root = planned.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f"), F.lit(None).cast("long").alias("parent"), "conv_id",
        "n_convs", F.lit(0).cast("long").alias("words"),
        F.lit(None).cast(rows.schema["ref_conv"].dataType).alias("ref_conv"), F.lit(None).cast("long").alias("ref_pos"),
    )
    return nodes.unionByName(root)


def _joined(f0: Column, f1: Column) -> Column:
    return f0 * (1 << 31) + f1


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``(depth, f, values)``: sums of ``values`` over each node and all below it.

    In round k a node sends the sum of what lies less than 2 ** k below it to its ancestor
    2 ** k above, which then knows what lies less than 2 ** (k + 1) below.
    """
    total = [F.sum(v).alias(v) for v in values]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now = nodes.select("depth", "f", F.col("parent").alias("up"), *values)
    parts, step = [nodes.select("depth", "f", *values)], 1
    while step <= deepest:
        now = materialise(now.where(F.col("depth") >= step))
        sent = materialise(
            now.groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("f")).agg(*total)
        )
        parts.append(sent)
        got = sent.select("depth", "f", *[F.col(v).alias(f"__{v}") for v in values])
        higher = now.select((F.col("depth") + step).alias("__depth"), F.col("f").alias("__f"), F.col("up").alias("__up"))
        lifted = now.where(F.col("depth") >= 2 * step).join(higher, (F.col("depth") == F.col("__depth")) & (F.col("up") == F.col("__f")))
        now = lifted.join(got, ["depth", "f"], "left").select(
            "depth", "f", F.col("__up").alias("up"), *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]
        )
        step *= 2
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    return all_parts.groupBy("depth", "f").agg(*total)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, f, ends_sha256)``: digest of the ids that end at a node, ascending and joined by commas."""
    kind = ends.schema["conv_id"].dataType.simpleString()
    order = ["depth", "f", "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, node = [], None

        def piece() -> dict:
            return {"depth": [node[0]], "f": [node[1]], "first": [held[0]], "ids": [",".join(map(str, held))]}

        for batch in batches:
            for depth, f, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != (depth, f) or len(held) == PIECE:
                    if held:
                        yield piece()
                    held, node = [], (depth, f)
                held.append(conv)
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        node, state = None, None
        for batch in batches:
            done = []
            for depth, f, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != (depth, f):
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, f), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield dict(zip(("depth", "f", "ends_sha256"), zip(*done, strict=True) if done else ([], [], []), strict=True))
        if node is not None:
            yield {"depth": [node[0]], "f": [node[1]], "ends_sha256": [state.hexdigest()]}

    sorted_ = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)
    pieces = map_batches(sorted_, join, f"depth long, f long, first {kind}, ids string", rows=1 << 13)
    dealt = pieces.repartition("depth", "f").sortWithinPartitions("depth", "f", "first")
    return map_batches(dealt, digest, "depth long, f long, ends_sha256 string", rows=64)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and ``ref_conv``,
    ``ref_pos``: the conversation and place, from 1, of the original turn that is the node's last.
    """
    for seed in range(ROUNDS):
        try:
            return _trie(conversations, seed)
        except Collision:
            continue
    raise RuntimeError(f"hashes collided under {ROUNDS} seeds")


def _trie(conversations: DataFrame, seed: int) -> DataFrame:
    opened = materialise(openings(turn_rows(conversations, seed)))
    planned = materialise(plans(opened))
    rows = materialise(members(opened, planned))
    nodes = materialise(node_rows(rows, planned))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("f")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    known = nodes.join(children, ["depth", "f"], "left").select(
        *nodes.columns, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children")
    )
    known = materialise(
        known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    )
    sums = subtree_sums(known, ["n_leaves", "saved_tokens"])
    at_root = planned.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f"), "conv_id")
    ends = rows.where("last").select("depth", _joined(F.col("f0"), F.col("f1")).alias("f"), "conv_id").unionByName(at_root)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = (
        known.drop("n_leaves", "saved_tokens")
        .join(sums, ["depth", "f"])
        .join(end_digests(ends), ["depth", "f"], "left")
        .join(above, ["depth", "parent"], "left")
    )
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "ref_conv", "ref_pos",
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("ref_conv", "ref_pos")


ORACLE_SQL = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS MATERIALIZED (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS own FROM turns GROUP BY conv_id
),
skips AS (SELECT conv_id, own, {crc32_sql("s")} % 4 AS h FROM (SELECT *, conv_id::VARCHAR AS s FROM convs)),
rebuilt AS MATERIALIZED (
    SELECT s.conv_id, coalesce(b.own[1 : s.h], []) || s.own[s.h + 1 :] AS path
    FROM skips s LEFT JOIN convs b ON b.conv_id = s.conv_id - ((s.conv_id % 20) + 20) % 20
),
openings AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM rebuilt),
nodes AS MATERIALIZED (
    SELECT depth, path[1 : depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CASE WHEN len(path) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
    FROM openings GROUP BY depth, path[1 : depth]
),
counted AS MATERIALIZED (
    SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved,
           path[1 : depth - 1] AS parent
    FROM nodes
),
children AS (SELECT parent AS path, depth - 1 AS depth, count(*) AS n_children FROM counted WHERE depth > 0 GROUP BY parent, depth),
known AS MATERIALIZED (
    SELECT c.*, coalesce(n_children, 0) AS n_children FROM counted c LEFT JOIN children k ON c.path = k.path AND c.depth = k.depth
),
upward AS (SELECT path, saved, n_children, unnest(range(depth + 1)) AS depth FROM known),
sums AS (
    SELECT path[1 : depth] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM upward GROUP BY path[1 : depth]
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN sums s ON k.path = s.path LEFT JOIN nodes p ON k.depth > 0 AND p.depth = k.depth - 1 AND p.path = k.parent
"""
