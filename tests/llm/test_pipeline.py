"""Each stage of the pipeline on the documents its predecessor kept, against brute force."""

from collections import Counter

from tests.llm.test_operators import brute_components, slow_spans

import corpus_pipeline as p
from hitloom.llm import toxicity
from hitloom.llm.common import materialize, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "sentencepiece"]
    at = {"input": docs}
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        at[name] = docs
        if name != names[-1]:
            assert docs.columns == at["input"].columns
    rows = {n: [(r.doc_id, r.text) if n != names[-1] else (r.doc_id, r.exact) for r in d.collect()] for n, d in at.items()}

    model = toxicity.fit(at["input"], table(spark, sf, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(at["input"], model).collect()}
    assert sorted(rows["toxicity"]) == sorted((i, t) for i, t in rows["input"] if scores[i] < 0.5)
    groups = brute_components(dict(rows["toxicity"]), 5)
    assert sorted(i for i, _ in rows["near_dedup"]) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert sorted(i for i, _ in rows["secrets"]) == sorted(i for i, _ in rows["near_dedup"])
    before = dict(rows["near_dedup"])
    for i, t in rows["secrets"]:
        assert not slow_spans(t) and (t == before[i] or slow_spans(before[i]) or "[secret]" in t)
    n = Counter(i for i, _ in rows["mixing"])
    texts = dict(rows["secrets"])
    assert set(n) <= set(texts) and max(n.values()) <= 2 and all(texts[i] == t for i, t in rows["mixing"])
    words = lambda t: len(t.encode().split())
    total = sum(map(words, texts.values()))
    assert abs(sum(words(t) for _, t in rows["mixing"]) - 1.5 * total) < 0.1 * total
    assert Counter(i for i, _ in rows["sentencepiece"]) == n and all(e for _, e in rows["sentencepiece"])
