"""Each stage on what its predecessor kept, against plain Python; odd rows through all stages."""

from collections import Counter

import corpus_pipeline
import pytest
from test_pii import plain_spans
from test_quality import plain_counts
from test_simhash import classes, plain_fingerprint
from test_tokens import check_packing
from tokenizers import Tokenizer

from pollspark.llm.quality import op8_quality_rules
from pollspark.llm.tokens import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    results = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        results.append(docs.collect())
    start = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    good, alone, masked, mixed, packed = results
    assert all(r.asDict().keys() == set(COLUMNS) for part in results[:4] for r in part)

    kept = {r.doc_id for r in op8_quality_rules(spark, small).collect() if r.kept}
    assert {tuple(r) for r in good} == {tuple(r) for r in start.values() if r.doc_id in kept}
    for r in start.values():
        n, _, _, _, repeated = plain_counts(r.text)
        assert r.doc_id not in kept or (n >= 10 and 100 * repeated <= 20 * n)

    root = classes({r.doc_id: plain_fingerprint(r.text) for r in good})
    assert sorted(tuple(r) for r in alone) == sorted(tuple(r) for r in good if root[r.doc_id] == r.doc_id)

    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in alone)
    for r in masked:
        before = start[r.doc_id].text
        assert (r.text == before) or "[" in r.text
        assert not any(before[a:b] in r.text for _, a, b in plain_spans(before))
        assert r.n_chars == len(r.text)
        if not any(c.isdigit() or c == "@" for c in before):
            assert r.text == before

    times = Counter(tuple(r) for r in mixed)
    assert set(times) == {tuple(r) for r in masked}
    assert set(times.values()) <= {1, 2}
    tokens = Counter()
    for r in masked:
        tokens[r.source] += len(r.text.split())
    largest = max(tokens, key=tokens.get)
    assert all(n == 1 for row, n in times.items() if row[COLUMNS.index("source")] == largest)

    tokenizer = Tokenizer.from_file(vocabulary_path())
    used, least = check_packing(packed, [(r.doc_id, r.text) for r in mixed], tokenizer)
    assert used <= 1.02 * least + 1


def test_odd_rows(spark, tmp_path):
    text = "This is a plain text of more than ten words, so that it stays here number {}."
    rows = [(i % 60, text.format(i % 55) + " More words follow for some of them." * (i % 3), "en", f"s{i % 3}", 1) for i in range(80)]
    rows += [(None, text.format("null id"), None, None, None), (90, None, "en", "s1", 0), (91, "", "en", "s1", 0), (92, text.format("x") * 3000, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        current = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{table is docs}-{i}")
            stage(spark, current, "").write.parquet(path)
            current = spark.read.parquet(path)
            if name == "near_dedup":
                found = current.collect()
                assert len({r.text for r in found}) == len(found)
        assert (current.count() > 20) == (table is docs)


def test_run(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns)
    assert found.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
