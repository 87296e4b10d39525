"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns (email, ip, card, phone) give the base spans of a text. The field labels the
text's tokens that have a digit or "@", are the value after a credential's name, or repeat
such a value (any other token is no entity): node features are shapes and neighbouring
words, chain edges join tokens next to each other, and skip edges join each token with
the next one that repeats it or its digits, however far away. Labels that a pattern gives
(``SECRET`` for credentials, besides the kinds) are evidence. Loopy message passing over
these edges makes labels agree across a document; it stops for each text on its own. A
token that the field labels with at least ``SURE`` adds a span unless a base span covers
part of it, so base spans always stay.

The field is trained by pseudo-likelihood on tokens that the patterns label, from about
``TRAIN_ROWS`` rows chosen by hash, and of each row all tokens or about ``TRAIN_TOKENS``
chosen by hash. That sample is the only bounded thing; all texts are searched whole.

Cases: a null text is empty; a text without digits, "@" and named credentials has no
spans; repeated rows are searched each on its own; an empty table gives no rows; a table
without any labelled token gives base spans, named credentials and their repeats.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm.common import map_batches, table, texts

KINDS = ["email", "ip", "card", "phone"]
#: Labels of the field: none, the base kinds, credentials.
LABELS = ["", *KINDS, "secret"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Starting at the first digit of a run changes no match, and long runs stay linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"""\b(?:token|key|secret|password)["']?\s*[=:]\s*["']?([A-Za-z0-9_/+-]{16,})""", re.I | re.A)
#: Words of which one stands in every ``SECRET``.
NAMES = ("token", "key", "secret", "password")
SUSPECT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'`()[]{}<>,;:!?#*$%&|=~^\\."

TRAIN_ROWS = 5000
#: Tokens of one row that enter the training sample, about, where it has more.
TRAIN_TOKENS = 200
FEATURES = 1 << 12
#: Potential of a label that a pattern gives, and of equal labels on a skip edge before training, which moves
#: it where the sample has such pairs: few texts repeat an entity.
EVIDENCE, SAME = 10.0, 10.0
SURE = 0.9
ROUNDS = 20


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start: leftmost matches without overlap inside a kind."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            spans.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not re.search("[0-9]", text):
        return spans
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def _shape(token: str) -> str:
    mapped = re.sub("[0-9]+", "9", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", token[:40])))
    return mapped[:16]


class Tokens:
    """The variables of some texts: spans, features and edges."""

    def __init__(self):
        self.text: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.known: list[int] = []
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, number: int, text: str, base: list[tuple[int, int, int]] = ()) -> None:
        """The variables of ``text``; ``base`` are its base spans, whose tokens have a known label."""
        low = text.lower()
        secrets = [m.span(1) for m in SECRET.finditer(text)] if any(n in low for n in NAMES) else []
        if not secrets and not SUSPECT.search(text):
            return
        wanted = set().union(*[self._keys(text[a:b]) for a, b in secrets])  # what letters alone may repeat
        begins, ends = merged([(k, a, b) for k, a, b in base])
        kinds = {a: k + 1 for k, a, _ in reversed(base)}
        values = [a for a, _ in secrets]
        last: dict[str, int] = {}
        before, before_variable, previous = "", -1, -2
        for place, m in enumerate(TOKEN.finditer(text)):
            raw = m.group()
            token = raw.strip(EDGES)
            start = m.start() + raw.index(token)
            value = bisect_left(values, m.start())
            named = value < len(values) and values[value] < m.end()
            if named and values[value] > start:  # the name and its value in one token
                token, start = text[values[value] : m.end()].rstrip(EDGES), values[value]
            keys = self._keys(token) if token else set()
            if token and (named or SUSPECT.search(raw) or not wanted.isdisjoint(keys)):
                i, end = len(self.text), start + len(token)
                covered = bisect_left(begins, end) - 1
                known = kinds[begins[covered]] if covered >= 0 and ends[covered] > start else len(LABELS) - 1 if named else 0
                self.text.append(number)
                self.start.append(start)
                self.end.append(end)
                self.known.append(known)
                self.features.append(self._features(token, raw, before, before_variable, place))
                if previous == place - 1:
                    self.chain.append((i - 1, i))
                previous = before_variable = place
                self.skip += sorted({(last[k], i) for k in keys if k in last})
                last.update(dict.fromkeys(keys, i))
            before = raw

    def sample(self, most: int) -> Tokens:
        """About ``most`` of the tokens, chosen by hash, and the edges between them."""
        n = len(self.text)
        if n <= most:
            return self
        kept = [i for i in range(n) if zlib.crc32(f"{i}:{self.start[i]}".encode()) * n < most << 32]
        new, out = {i: k for k, i in enumerate(kept)}, Tokens()
        columns = (self.text, self.start, self.end, self.known, self.features)
        out.text, out.start, out.end, out.known, out.features = ([x[i] for i in kept] for x in columns)
        out.chain, out.skip = ([(new[a], new[b]) for a, b in x if a in new and b in new] for x in (self.chain, self.skip))
        return out

    @staticmethod
    def _keys(token: str) -> set[str]:
        """What makes two tokens the same: letters with digits, many digits, the name in an address."""
        plain = "".join(c for c in token.lower() if c.isalnum())
        digits = "".join(c for c in token if c in "0123456789")
        keys = {f"w{plain}"} if len(plain) > 3 and len(plain) > len(digits) else set()
        if len(digits) > 6:
            keys.add(f"d{digits}")
        if "@" in token and SUSPECT.search(name := token.split("@")[0]):
            keys.add("w" + "".join(c for c in name.lower() if c.isalnum()))
        return keys

    @staticmethod
    def _features(token: str, raw: str, before: str, before_variable: int, place: int) -> list[int]:
        digits = sum(c in "0123456789" for c in token)
        hexa = len(token) >= 16 and not token.lower().strip("0123456789abcdef")
        named = [
            "bias", f"s{_shape(token)}", f"r{_shape(raw)}", f"l{min(len(token), 40) // 4}", f"d{min(digits, 20)}", f"h{hexa}",
            f"a{'@' in token}{min(token.count('.'), 4)}", f"p{before[-12:].lower()}", f"q{_shape(before)}", f"v{before_variable == place - 1}",
        ]
        return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in named]


class Field:
    """Weights of the field: per feature and label, per chain edge, per skip edge."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    @classmethod
    def train(cls, features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, epochs: int = 120, decay: float = 1e-4) -> Field:
        """Pseudo-likelihood: each token given the labels of its neighbours, by full-batch adaptive gradient."""
        k, n = len(LABELS), len(labels)
        node, edge, same = np.zeros((FEATURES, k)), [np.zeros((k, k)), np.eye(k) * SAME], np.eye(k) * SAME
        if n == 0:
            return cls(node, *edge)
        memory = [np.full_like(node, 1e-8), np.full((k, k), 1e-8), np.full((k, k), 1e-8)]
        truth = np.eye(k)[labels]
        for _ in range(epochs):
            logits = node[features].sum(axis=1)
            for w, pairs in zip(edge, (chain, skip), strict=True):
                np.add.at(logits, pairs[:, 1], w[labels[pairs[:, 0]]])
                np.add.at(logits, pairs[:, 0], w.T[labels[pairs[:, 1]]])
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            rest = (truth - p) / n
            grads = [np.zeros_like(node)]
            np.add.at(grads[0], features.ravel(), np.repeat(rest, features.shape[1], axis=0))
            for pairs in (chain, skip):
                g = np.zeros((k, k))
                np.add.at(g, labels[pairs[:, 0]], rest[pairs[:, 1]])
                np.add.at(g.T, labels[pairs[:, 1]], rest[pairs[:, 0]])
                grads.append(g)
            for w, g, m in zip((node, *edge), grads, memory, strict=True):
                g -= decay * (w - same if w is edge[1] else w)
                m += g * g
                w += 0.5 * g / np.sqrt(m)
        return cls(node, *edge)

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Label probabilities by loopy message passing over all texts of ``tokens`` at once."""
        own = self.node[np.array(tokens.features, dtype=np.int64)].sum(axis=1)
        known = np.flatnonzero(tokens.known)
        own[known, np.array(tokens.known, dtype=np.int64)[known]] += EVIDENCE
        pairs = np.array(tokens.chain + tokens.skip, dtype=np.int64).reshape(-1, 2)
        if len(pairs):
            kinds = (np.arange(len(pairs)) >= len(tokens.chain)).astype(np.int64)
            both = np.stack([self.chain, self.skip])
            left, right = pairs.T
            to_right, to_left = np.zeros((len(pairs), len(LABELS))), np.zeros((len(pairs), len(LABELS)))
            owner = np.unique(np.array(tokens.text)[left], return_inverse=True)[1]
            unsettled = np.ones(owner.max() + 1, dtype=bool)
            for _ in range(ROUNDS):
                live = np.flatnonzero(unsettled[owner])
                if not len(live):
                    break
                belief = own.copy()
                np.add.at(belief, right, to_right)
                np.add.at(belief, left, to_left)
                change = np.zeros(len(unsettled))
                for a in range(0, len(live), 20_000):
                    part = live[a : a + 20_000]
                    w = both[kinds[part]]
                    new_right = _lse(belief[left[part]][:, :, None] - to_left[part][:, :, None] + w, 1)
                    new_left = _lse(belief[right[part]][:, None, :] - to_right[part][:, None, :] + w, 2)
                    for messages, new in ((to_right, new_right), (to_left, new_left)):
                        new -= new.max(axis=1, keepdims=True)
                        apart = new - messages[part]
                        np.maximum.at(change, owner[part], np.abs(apart).max(axis=1))
                        messages[part] += 0.7 * apart  # damped, so that loops settle
                unsettled &= change >= 1e-3
            own = own.copy()
            np.add.at(own, right, to_right)
            np.add.at(own, left, to_left)
        own = np.exp(own - own.max(axis=1, keepdims=True))
        return own / own.sum(axis=1, keepdims=True)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _covers(spans: list[tuple[int, int, int]], start: int, end: int) -> int | None:
    return next((k for k, a, b in spans if a < end and start < b), None)


def merged(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that ``(kind, start, end)`` cover."""
    begins, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def find(values: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and the spans that the field adds, as ``(label, start, end)``."""
    base = [base_spans(t) for t in values]
    tokens = Tokens()
    for i, text in enumerate(values):
        tokens.add(i, text, base[i])
    added: list[list] = [[] for _ in values]
    if tokens.text:
        p = field.marginals(tokens)
        best = p.argmax(axis=1)
        joined = {b for a, b in tokens.chain if best[a] == best[b]}
        last = -2
        covered: dict[int, tuple[list[int], list[int]]] = {}
        for j in np.flatnonzero((best > 0) & (p.max(axis=1) >= SURE)).tolist():
            number, start, end = tokens.text[j], tokens.start[j], tokens.end[j]
            if number not in covered:
                covered[number] = merged(base[number])
            begins, ends = covered[number]
            near = bisect_left(begins, end)
            if near and ends[near - 1] > start:
                continue
            if j in joined and last == j - 1:
                added[number][-1] = (*added[number][-1][:2], end)
            else:
                added[number].append((LABELS[best[j]], start, end))
            last = j
    return [([(KINDS[k], a, b) for k, a, b in found], extra) for found, extra in zip(base, added, strict=True)]


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Field:
    """The field, from about ``rows`` suspect rows chosen by hash; the driver holds their tokens."""
    suspect = texts(docs, text_col, id_col).where(F.col(text_col).rlike(f"[0-9@]|(?i:{'|'.join(NAMES)})[\"']?\\s*[=:]")).select(
        F.col(text_col).alias("text"), F.xxhash64(text_col, id_col).alias("h")
    )
    n = suspect.count()
    if n > rows:
        suspect = suspect.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * (rows / n))))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"features": [], "labels": [], "chain": [], "skip": []}
            for text in batch.column(0).to_pylist():
                tokens = Tokens()
                tokens.add(0, text)
                tokens = tokens.sample(TRAIN_TOKENS)
                known = [(k + 1, a, b) for k, a, b in base_spans(text)]
                known += [(len(LABELS) - 1, *m.span(1)) for m in SECRET.finditer(text)]
                out["features"].append([f for fs in tokens.features for f in fs])
                out["labels"].append([_covers(known, a, b) or 0 for a, b in zip(tokens.start, tokens.end, strict=True)])
                out["chain"].append([x for pair in tokens.chain for x in pair])
                out["skip"].append([x for pair in tokens.skip for x in pair])
            yield out

    found = map_batches(suspect.select("text"), step, "features array<int>, labels array<int>, chain array<int>, skip array<int>")
    sample = sorted(tuple(map(tuple, r)) for r in found.collect())
    features, labels, edges, size = [], [], ([], []), 0
    for f, lab, chain, skip in sample:
        features += f
        labels += lab
        for known, pairs in zip(edges, (chain, skip), strict=True):
            known += [x + size for x in pairs]
        size += len(lab)
    width = len(features) // size if size else 1
    pairs = [np.array(e, dtype=np.int64).reshape(-1, 2) for e in edges]
    return Field.train(np.array(features, dtype=np.int64).reshape(size, width), np.array(labels, dtype=np.int64), *pairs)


SPAN = "array<struct<kind: string, start: int, end: int>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``(id, base, added)``: spans in code points, end exclusive, of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    field = field or train_field(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 4096 x 6 weights

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = find(batch.column(1).to_pylist(), shared.value)
            named = [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in part] for part in zip(*found, strict=True)]
            yield {"id": batch.column(0), "base": named[0], "added": named[1]}

    return map_batches(texts(docs, text_col, id_col), step, f"`{id_col}` {kind}, base {SPAN}, added {SPAN}")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans make one replacement."""
    out, end = [], 0
    first = {a: kind for kind, a, b in sorted(spans, key=lambda s: s[2])}
    for a, b in zip(*merged(spans), strict=True):
        out += [text[end:a], f"[{first[a].upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with all found spans masked in the text; null texts stay null, other columns as they are."""
    field = field or train_field(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            found = find([t or "" for t in values], shared.value)
            masked = [t and mask(t, [*b, *a]) for t, (b, a) in zip(values, found, strict=True)]
            yield {str(i): masked if i == at else batch.column(i) for i in range(batch.num_columns)}

    return map_batches(docs, step, docs.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    found = personal_data(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    order = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(F.array_position(F.array(*map(F.lit, LABELS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return found.select(
        "doc_id",
        *[counted(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(order)).alias("spans"),
    )
