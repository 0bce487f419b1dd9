from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabvet.llm.bpe_chunks import encode_decode

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    raw = library.decode_bytes(ids)
    assert raw == (text or "").encode()
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())


def rows_of(df):
    return {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()}


def test_edge_texts_and_all_chunk_sizes(spark, library):
    rng = random.Random(5)
    alphabet = ["a", "B", " ", " ", "\n", "'", "re", "'ve", "ll", "7", "é", "日本", "😀", "!", "\t", "#"]
    texts = [None, "", " ", "x" * 5000, " " * 3000, "we're " * 700, "it's'd'll''re" * 200, "\r\n \u00a0x" * 300]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    want = {i: expected(library, t) for i, t in enumerate(texts)}
    for chunk, overlap in ((16_384, 512), (40, 12), (97, 31)):
        got = rows_of(encode_decode(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap))
        assert got == want, (chunk, overlap)


def test_repeated_rows_null_ids_and_empty_table(spark, library):
    docs = spark.createDataFrame([(None, "a b"), (3, "z" * 90), (3, "z" * 90)], "doc_id long, text string")
    out = encode_decode(docs, RANKS, public_tokenizers.PATTERN, 40, 10).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted(
        [(-1, expected(library, "a b")[0])] + [(3, expected(library, "z" * 90)[0])] * 2)
    assert encode_decode(docs.where(F.lit(False)), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_matches_library(spark, sf, library):
    from tabvet.llm.q_tokens import op10_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows_of(op10_byte_bpe(spark, sf)) == {i: expected(library, t) for i, t in texts.items()}
