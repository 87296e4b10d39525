"""Licence scans, token counts and chat formatting against plain Python and public tokenizers."""

import hashlib
import random
import re

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from pollspark.llm.chat import CONSTANTS, CONTROL, Template, TemplateError, escape, escape_line, format_conversations, op9_chat_formatting, parse_turns, read_back, unescape
from pollspark.llm.licences import BASE, TEMPLATES, Index, inverse_frequencies, op4_license_scan, scan_licences, words
from pollspark.llm.unigram import CountViterbi, count_pieces, load_pieces, op6_token_counts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    found = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in op4_license_scan(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    assert sum(r.n_base for r in rows.values()) > 0
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score >= 0.8 or not r.labels)


def test_templates_are_found_anywhere_and_near_ones_only():
    vocabulary = {w for phrase in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in words(phrase)}
    index = Index({w: float(len(w)) for w in vocabulary})
    rng = random.Random(1)
    for label, text, _ in TEMPLATES:
        filler = [rng.choice(["x", "the", "of", "license", "public"]) for _ in range(50)]
        found, score = index.scan(words(" ".join([*filler, text.upper(), *filler])))
        assert label in {m[0] for m in found} and score == 1
        assert any(m[0] == label and m[1] == 50 for m in found)
    long = next(t for k, t, _ in TEMPLATES if k == "apache-notice").split()
    assert "apache-notice" in {m[0] for m in index.scan(words(" ".join([*long[:3], "really", *long[3:]])))[0]}
    assert "apache-notice" not in {m[0] for m in index.scan(words(" ".join(long[:8])))[0]}
    shuffled = long[:]
    rng.shuffle(shuffled)
    assert index.scan(words(" ".join(shuffled)))[0] == []
    assert index.scan([]) == ([], 0.0)


LICENCE_ODD = [
    (1, None, "x"), (2, "", "x"), (3, "MIT License", "x"), (3, "MIT License", "x"), (None, "cc by cc-by CC.BY", None),
    (4, "gnu general public license " * 5000, "x"), (5, "é apachelicense apache\x00license 日本 mit\nlicense", "x"), (6, "apache", "x"),
]


def test_licences_of_odd_rows(spark):
    docs = spark.createDataFrame(LICENCE_ODD, "doc_id long, text string, matches string")
    got = scan_licences(docs).collect()
    as_rows = []
    for r in got:
        base = [m for m in r.matches if m.base]
        firsts = [m["first"] for m in base]
        as_rows.append((str(r.doc_id), r.n_words, len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({m.label for m in base}))))
    assert sorted(map(str, as_rows)) == sorted(str((str(k), *plain_base(t))) for k, t, _ in LICENCE_ODD)
    assert scan_licences(docs.limit(0)).collect() == []
    idf = inverse_frequencies(docs)
    assert idf[b"license"] < idf[b"eclipse"]


@pytest.fixture(scope="module")
def unigram():
    pieces, unknown = load_pieces()
    made = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


COUNT_ODD = ["", "hello world", " hello  world ", "\n a\tb\n\n", "日本語 テスト 😀😀 x", "<s> <unk> <0x0A>", "▁x ▁▁ y", "  ", "x" * 20_000, "a b " * 20_000]


def test_counts_equal_the_tokenizer(unigram):
    rng = random.Random(1)
    pool = ["the", "a", "é", "ß", " ", "日", "😀", "x\n", "@@", "▁", " ", "zq"]
    values = COUNT_ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    count = CountViterbi(load_pieces()[0], memo=1000)
    for i in range(0, len(values), 500):
        for text, (n, _, _) in zip(values[i : i + 500], count.counts(values[i : i + 500]), strict=True):
            assert n == len(unigram.encode(text, add_special_tokens=False).ids), text


def test_ties_and_unknown_runs_without_bytes():
    rng = random.Random(2)
    for seed in range(30):
        letters = "abc"
        pieces = [("<unk>", 0.0), ("▁", -1.0)] + list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 3))): float(-rng.randint(1, 3)) for _ in range(6)}.items())
        made = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        count = CountViterbi(pieces, byte_fallback=False)
        values = ["".join(rng.choice(letters + "d e") for _ in range(rng.randint(0, 12))) for _ in range(200)]
        for text, (n, _, _) in zip(values, count.counts(values), strict=True):
            assert n == len(made.encode(text, add_special_tokens=False).ids), (seed, text, pieces)


def test_counts_of_all_documents(spark, sf_dir, unigram):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r.n_pieces for r in op6_token_counts(spark, sf_dir).collect()}
    assert rows == {d.doc_id: len(unigram.encode(d.text, add_special_tokens=False).ids) for d in docs}
    odd = spark.createDataFrame([(i % 7 if i else None, t, i) for i, t in enumerate([*COUNT_ODD, None])], "doc_id long, text string, n_pieces int")
    assert sorted(r.n_pieces for r in count_pieces(odd).collect()) == sorted(len(unigram.encode(t or "", add_special_tokens=False).ids) for t in [*COUNT_ODD, None])
    assert count_pieces(odd.limit(0)).collect() == []


def plain_digests(turns):
    said, loss = "", ""
    for role, text in turns:
        said += f"{role or ''}\n{text or ''}\n"
        loss += (text or "") if role == "assistant" else ""
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check_conversations(rows, turns):
    expected = {}
    for conv, turn, role, text in turns:
        expected.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    expected = {c: plain_digests([(r, t) for *_, r, t in sorted(v)]) for c, v in expected.items()}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == expected
    assert len(rows) == len(expected)


def test_all_conversations(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = op9_chat_formatting(spark, sf_dir).collect()
    check_conversations(rows, turns)
    sizes = {r.conv_id: r.formatted_chars for r in rows}
    for conv in list(sizes)[:50]:
        made = "".join(p for ps in Template().render([(r, t) for c, n, r, t in sorted(turns) if c == conv]) for p, _ in ps)
        assert len(made) == sizes[conv]


def test_odd_conversations_and_parts(spark):
    rng = random.Random(4)
    pool = [*CONTROL, "\\", "\n", "<", "[", "a", "<|end|>\n", "é😀", "<|turn|>assistant\n"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "tool\nx", "\\", None]), "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for c in range(20) for t in range(rng.randint(1, 30))]
    turns += [(None, 0, "assistant", None), (30, 0, None, ""), (30, 0, None, ""), (31, None, "assistant", "x" * 300_000), (30, 1, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'z' AS loss")
    for part in (10, 1 << 20):
        formatted = format_conversations(df, part=part)
        check_conversations(read_back(formatted).collect(), turns)
    assert format_conversations(df, part=10).where("part > 0").count() > 0
    assert read_back(format_conversations(df.limit(0))).collect() == []


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice([*CONTROL, "\\", "<", "|", "s>", "[", "INST]", "\n"]) for _ in range(rng.randint(0, 8)))
        assert unescape(escape(text)) == text and unescape(escape_line(text)) == text
        assert not any(c in escape(text) for c in CONTROL)
        [(role, said, _)] = parse_turns("".join(p for ps in Template().render([(text, text)]) for p, _ in ps), True)
        assert (role, said) == (text, text)


def test_compiler():
    render = lambda source, messages=(("user", " hi "),), **k: "".join(p for ps in Template(source, {**CONSTANTS, **k}).render(messages) for p, _ in ps)
    assert render("{{ 'a' + \"b\" }}{# no #}{% if 1 == 2 or not (x == 'y') %}yes{% elif true %}2{% else %}no{% endif %}", x="z") == "abyes"
    assert render("{% for m in messages %}{{ m['role'] | upper }}:{{ m.content | trim }}{{ ';' if not loop.last else '.' }}{{ loop.index }}{% endfor %}!", [("a", "b"), ("c", "d")]) == "A:b;1C:d.2!"
    folded = Template("a{{ bos }}{% if bos == '<s>' %}b{% else %}{{ bos }}{% endif %}c")
    assert folded._melt(folded._block(())) == [] and [p for ps in folded.render([]) for p in ps] == [("a<s>bc", False)]
    masks = [p for ps in Template("x{% for m in messages %}{% generation %}{{ m.content }}{% endgeneration %}-{% endfor %}").render([("r", "t")]) for p in ps]
    assert masks == [("x", False), ("t", True), ("-", False)]
    for bad in (
        "{{ message.role }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ open('x') }}", "{% for m in x %}{% endfor %}", "{% if 1 %}",
        "{{ 'a' | system }}", "{{ }}", "{{ 'a' 'b' }}", "{% import x %}", "{% for m in messages %}{% for k in messages %}{% endfor %}{% endfor %}", "{{ 1 ; 2 }}",
    ):
        with pytest.raises(TemplateError):
            Template(bad)


def plain_labels(found, idf):
    """Labels of all places of every template that match, without an index."""
    index = Index(idf)
    out = set()
    for number, (label, text, _, exact) in enumerate(index.templates):
        drift = index.drift(number)
        for start in range(-len(text), len(found) + 1):
            if exact:
                if start >= 0 and found[start : start + len(text)] == text:
                    out.add(label)
                continue
            same = sum(any(0 <= i < len(found) and found[i] == w for i in range(start + p - drift, start + p + drift + 1)) for p, w in enumerate(text))
            stands = all(
                any(a >= 0 and found[a : a + len(k)] == k for a in range(start + p - drift, start + p + drift + 1)) for p, k in index.keys[number]
            )
            if same >= 0.8 * len(text) - 1e-9 and stands:
                out.add(label)
    return out


def test_no_place_of_enough_cover_is_missed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.01', '0.001')}/documents.parquet")
    idf = inverse_frequencies(docs)
    index, rng = Index(idf), random.Random(6)
    texts = [words(r.text or "")[:400] for r in docs.limit(60).collect()]
    for _, text, _ in TEMPLATES:
        found = words(text)
        for lost in (1, 2, 3, 5):
            changed = list(found)
            for p in rng.sample(range(len(found)), min(lost, len(found))):
                changed[p] = b"zzz"
            texts.append([b"some", b"words", *changed, b"of", b"license"])
            extra = list(found)
            for p in sorted(rng.sample(range(len(found)), min(lost, len(found))), reverse=True):
                extra.insert(p, b"dnl")
            texts += [extra, extra[2:], extra[:-2], found + extra]
    for found in texts:
        assert {m[0] for m in index.scan(found)[0]} == plain_labels(found, idf)


def test_a_notice_with_three_rare_words_altered(spark):
    notice = next(text for label, text, _ in TEMPLATES if label == "mit-notice").split()
    index = Index({})
    rare = sorted(range(len(notice)), key=lambda p: (notice[p], p))[:4]
    changed = ["zzz" if p in rare[:3] else w for p, w in enumerate(notice)]
    found = [w.encode() for w in changed]
    if all(k in " ".join(changed) for k in ("hereby granted free of charge", "deal in the software without restriction")):
        assert [m[0] for m in index.scan(found)[0]] == ["mit-notice"]
    assert index.scan(found)[1] > 0.85
