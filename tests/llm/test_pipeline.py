"""The corpus pipeline, stage by stage, against brute force on the smallest table."""

from collections import Counter

import pytest

import corpus_pipeline as P
from rfmlens.llm import common, secret_scan
from test_text_operators import SF, brute_components, brute_spans, brute_targets, words


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        docs = common.keep(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "secrets", "mix", "bpe"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def rejected(text):
    w, text = words(text), text or ""
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeat = len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)})
    lines = [x for x in text.split("\n") if words(x)]
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    return (len(w) < 50 or 100 * repeat > 50 * len(w) or 10 * symbols > len(w)
            or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or not 2 * len(w) <= chars <= 15 * len(w))


def test_quality(stages):
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in stages[0].collect() if not rejected(r.text)}


def test_near_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    kept = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert Counter(r.doc_id for r in stages[2].collect()) == dict.fromkeys(kept, 1)


def test_secrets(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    hit = 0
    for r in stages[3].collect():
        text = before[r.doc_id].text
        spans = brute_spans(text)
        hit += bool(spans)
        assert not brute_spans(r.text) and r.n_chars == (len(r.text) if spans else before[r.doc_id].n_chars)
        if not spans:
            assert r.text == text or "[SECRET]" in r.text
    assert hit and len(before) == stages[3].count()


def test_mix(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in before.values():
        n = len(words(r.text))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in stages[4].collect():
        assert r == before[r.doc_id]
        taken[r.source] += len(words(r.text))
    for s, goal in brute_targets(sizes).items():
        assert abs(taken[s] - goal) <= 0.5 * largest[s] + 1e-6


def test_bpe(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].collect())
    for r in rows:
        assert r.round_trip and r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_and_edges(spark, stages):
    assert P.run(spark, SF).count() == stages[5].count() and P.ORACLE_SQL is None
    empty = stages[0].limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, None, "en", "a", None)], stages[0].schema)
    for docs in (empty, odd):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 3 * docs.count()
    assert secret_scan.KINDS[3] == "inferred"
