from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabvet.llm import simple8b
from tabvet.llm.simple8b import decode, decode_slice, encode, read_documents, word_offsets, write_blocks

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    w = encode(v)
    assert decode(w, len(v)).tolist() == values
    assert len(w) <= 2 * len(v)


def test_slices_and_packing():
    rng = np.random.default_rng(3)
    v = np.concatenate([np.zeros(6000, np.uint64), rng.integers(0, 50_000, 9000).astype(np.uint64),
                        rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2), np.ones(500, np.uint64)])
    w = encode(v)
    off = word_offsets(w)
    for lo, hi in ((0, 1), (0, len(v)), (5999, 6003), (14_990, 15_010), (15_100, 15_800), (16_399, 16_400)):
        assert decode_slice(w, off, lo, hi).tolist() == v[lo:hi].tolist()
    assert len(encode(np.zeros(600, np.uint64))) == 10
    assert len(encode(np.full(400, 32_767, np.uint64))) == 100


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_edge_rows(spark, monkeypatch):
    rows = [(5, None), (None, "lost id"), (2, ""), (2, ""), (9, "We're  here\x1f!! ok <|endoftext|> É é ǅ"),
            (1, "word " * 30_000), (7, "x" * 3000), (8, "\n\t ")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string")
    assert result(read_documents(write_blocks(docs, PATH, 2))) == expected(rows)
    assert read_documents(write_blocks(docs.where(F.lit(False)), PATH, 2)).count() == 0


def test_query_matches_library(spark, sf):
    from tabvet.llm.q_tokens import op5_simple8b

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op5_simple8b(spark, sf)) == expected(rows)
    assert simple8b.SELECTORS[0] == (60, 1) and simple8b.SELECTORS[-1] == (1, 60) and len(simple8b.SELECTORS) == 14
