"""Every stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from tabvet.llm.common import stored, table
from tabvet.llm.mixing import MAX_RATE
from tabvet.llm.pii import base_spans, replaced
from tests.llm.test_bpe_chunks import RANKS, expected as tokens_of
from tests.llm.test_mixing import WORD, shared_targets
from tests.llm.test_ngram_join import expected as components_of
from tests.llm.test_quality_rules import counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def library():
    import base64

    import public_tokenizers
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "byte_bpe"]
    inputs, outputs = [], []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        outputs.append(docs.collect())
        if name != "byte_bpe":
            assert docs.columns == COLUMNS

    # 1: with this few labels no cutoff is admissible, so the base rules decide; rows are untouched
    want = {r.doc_id: tuple(r) for r in inputs[0] if not counts(r.text)[5]}
    assert {r.doc_id: tuple(r) for r in outputs[0]} == want

    # 2: the smallest id of each component
    groups = components_of([(r.doc_id, r.text) for r in inputs[1]])
    assert sorted(r.doc_id for r in outputs[1]) == sorted({c for _, _, c in groups})

    # 3: base spans are gone, documents without any are untouched
    before = {r.doc_id: r for r in inputs[2]}
    assert len(outputs[2]) == len(before)
    for r in outputs[2]:
        own = before[r.doc_id]
        assert r.n_chars == len(r.text)
        if not base_spans(own.text):
            assert tuple(r) == tuple(own)
        else:
            assert r.text == replaced(own.text, []) or "<TERM>" in r.text
            assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)

    # 4: rows come back unchanged, as often as taken, and each source is near its target
    originals = {r.doc_id: tuple(r) for r in inputs[3]}
    taken = Counter(r.doc_id for r in outputs[3])
    assert all(tuple(r) == originals[r.doc_id] for r in outputs[3]) and max(taken.values()) <= MAX_RATE
    size = {r.doc_id: len(WORD.findall(r.text)) for r in inputs[3]}
    source = {r.doc_id: r.source for r in inputs[3]}
    total, mixed = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
        mixed[source[i]] += n * taken[i]
    for s, target in shared_targets(dict(total)).items():
        assert abs(mixed[s] - target) <= max(n for i, n in size.items() if source[i] == s)

    # 5: the library's ids, one row per row of the mix
    enc = library()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in outputs[4]) == sorted(
        (r.doc_id, *tokens_of(enc, r.text)) for r in inputs[4])
