"""Base spans against the patterns as written, the field against enumeration, spans across a document, masking."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pollspark.llm.pii import FEATURES, KINDS, LABELS, Field, Tokens, base_spans, find, mask, op5_personal_data, personal_data, redact, train_field

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in digits][::-1]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    for alphabet in ("ab.@-1 ", "0123456789 -", "12.@ a", "+1(2) .-9a", "a@b.c%+"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert [(KINDS[k], a, b) for k, a, b in base_spans(text)] == plain_spans(text), text


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in op5_personal_data(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        spans = plain_spans(d.text)
        r = rows[d.doc_id]
        names = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in KINDS]
        listed = r.spans.split(",") if r.spans else []
        assert set(names) <= set(listed)
        assert listed == sorted(listed, key=lambda s: (LABELS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_messages_give_exact_marginals_on_a_tree():
    rng = np.random.default_rng(0)
    k, tokens = len(LABELS), Tokens()
    tokens.text, tokens.features = [0] * 4, [[0, i + 1] for i in range(4)]
    tokens.chain, tokens.skip = [(0, 1), (1, 2)], [(1, 3)]
    node = np.zeros((FEATURES, k))
    node[:5] = rng.normal(size=(5, k))
    field = Field(node, rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    own = node[np.array(tokens.features)].sum(axis=1)
    total = np.zeros((4, k))
    for labels in itertools.product(range(k), repeat=4):
        score = sum(own[i, x] for i, x in enumerate(labels))
        score += sum(field.chain[labels[a], labels[b]] for a, b in tokens.chain) + sum(field.skip[labels[a], labels[b]] for a, b in tokens.skip)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    assert field.marginals(tokens) == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=1e-3)


def test_repeated_tokens_agree_across_a_document():
    """A doubtful token takes the label of its far repetition; without skip edges it does not."""
    k = len(LABELS)
    text = 'token = "0123456789abcdef0123" ' + "filler " * 500 + "0123456789abcdef0123 end"
    tokens = Tokens()
    tokens.add(0, text)
    assert tokens.skip == [(0, 1)] and tokens.chain == []
    node = np.zeros((FEATURES, k))
    node[tokens.features[0][7], 5] = 6.0  # the word before speaks for a secret
    skip = np.eye(k) * 4
    linked = Field(node, np.zeros((k, k)), skip).marginals(tokens)
    alone = Field(node, np.zeros((k, k)), np.zeros((k, k))).marginals(tokens)
    assert linked[1, 5] > 0.7 > 0.3 > alone[1, 5]


def test_trained_field_finds_what_the_patterns_miss(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train_field(docs)
    text = 'Das ist token = "' + "0a1b2c3d4e" * 4 + '" und +1 (826) 555-4081 190.137.2.19 hier. Version 4.0 von 2019'
    (base, added), (none, extra) = find([text, "Chapter 3 of 12, version 4.0, in 2019 or 2020."], field)
    assert ("secret", 17, 57) in added
    assert [text[a:b] for k, a, b in added if k == "phone"] in ([], ["+1 (826) 555-4081"])
    assert none == extra == []
    masked = mask(text, [*base, *added])
    assert "[SECRET]" in masked and "190.137" not in masked and masked.endswith(" hier. Version 4.0 von 2019")
    clean = [r.text for r in docs.collect() if not re.search("[0-9@]", r.text)][:200]
    assert all(b == a == [] for b, a in find(clean, field))


def test_mask_of_overlapping_spans():
    assert mask("call 1234 now", [("card", 5, 8), ("ip", 6, 9)]) == "call [CARD] now"
    assert mask("ab", [("ip", 0, 1), ("card", 1, 2)]) == "[IP][CARD]"
    assert mask("", []) == ""


ODD = [
    (1, None, "a"), (2, "", "b"), (3, "me@x.org", "c"), (3, "me@x.org", "c"), (None, "1.2.3.4", None), (4, "9" * 30_000, "d"),
    (5, "a" * 30_000 + "@", "e"), (6, "1." * 20_000, "f"), (7, "😀 me@x.org 😀 +49 (30) 123-4567", "g"), (8, "u@a.bc " * 3000, "h"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, base string")
    got = personal_data(docs).collect()
    assert sorted((str(r.doc_id), sorted((s.kind, s.start, s.end) for s in r.base)) for r in got) == sorted(
        (str(k), sorted(plain_spans(t or ""))) for k, t, _ in ODD
    )
    hidden = {(r.doc_id, r.text, r.base) for r in redact(docs).collect()}
    assert {(1, None, "a"), (2, "", "b"), (3, "[EMAIL]", "c"), (None, "[IP]", None), (7, "😀 [EMAIL] 😀 [PHONE]", "g")} <= hidden
    assert personal_data(docs.limit(0)).collect() == []
    assert redact(docs.limit(0)).collect() == []


def test_letters_alone_are_found_after_a_name_and_where_they_repeat(spark, sf_dir):
    field = train_field(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    word = "abcdefghijklmnopqrst"
    far = f"password: {word} " + "filler words " * 300 + f"and {word} again, others qrstabcdefghijklmnop not."
    (base, added), = find([far], field)
    assert base == [] and ("secret", 10, 30) in added
    assert [far[a:b] for _, a, b in added] == [word, word]  # the far one by its skip edge alone
    alone = Field(field.node, field.chain, np.zeros_like(field.skip))
    assert len(find([far], alone)[0][1]) == 1
    (_, glued), = find([f"config password={word}; end"], field)
    assert [("secret", 16, 36)] == glued
    assert find(["The key: point is the token of secret passwords, no more."], field) == [([], [])]


def test_numbers_that_look_like_an_address_stay(spark, sf_dir):
    field = train_field(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = "from 1.2.3.4 in 1234 and info@example.org for info, 20 1234"
    (base, added), = find([text], field)
    assert len(base) == 2 and added == []


def test_marginals_do_not_depend_on_other_texts():
    rng = np.random.default_rng(2)
    k = len(LABELS)
    field = Field(rng.normal(size=(FEATURES, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)) * 2)
    texts = [" ".join(str(rng.integers(0, 10 ** int(rng.integers(1, 9)))) for _ in range(int(n))) + " 12345678 x 12345678" for n in rng.integers(1, 30, 20)]
    together = Tokens()
    for i, t in enumerate(texts):
        together.add(i, t)
    every, at = field.marginals(together), np.array(together.text)
    for i, t in enumerate(texts):
        own = Tokens()
        own.add(0, t)
        assert np.abs(field.marginals(own) - every[at == i]).max() < 1e-12


def test_sample_by_hash_takes_tokens_from_everywhere():
    tokens = Tokens()
    tokens.add(0, " ".join(str(i % 997 + 1000) for i in range(5000)))
    part = tokens.sample(200)
    assert 120 < len(part.text) < 300 and max(part.start) > 0.9 * max(tokens.start)
    assert all(part.start[a] < part.start[b] for a, b in part.chain + part.skip)
    assert tokens.sample(5000) is tokens
