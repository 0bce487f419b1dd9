"""Byte-level BPE encoding and decoding by overlapping chunks (operator 10).

A text is cut into overlapping chunks that any task can take.  Each chunk is
pre-tokenised on its own.  Inside the overlap of two neighbours the first
position that both hold as a pre-token boundary is where they resynchronise:
what the pattern matches from a boundary on depends only on the characters
behind it, so from there on both agree.  Each chunk then encodes the pieces
between its two seams; ids are concatenated in chunk order, and decoding
concatenates the raw bytes of the ids.  A text that has a seam without a
common boundary (one piece longer than the overlap) is pre-tokenised whole.

Defined results: a null text is an empty text (no ids, digests of nothing);
a null ``doc_id`` and repeated rows keep one output row per input row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import shuffle_partitions, stored

#: Code points per chunk and of the overlap with the next one.
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
#: A match may look this far: matches that end nearer to the end of a chunk can change with the text behind it.
LOOKAHEAD_CHARS = 3


class PieceEncoder:
    """The pattern and the ranks: boundaries, pieces and their ids."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        names = {i: str(i) for i in ranks.values()}
        self.name = names.__getitem__

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk without neighbours: its pieces need no stitching."""
        return self.encoding.encode_ordinary(text)

    def encode(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            ids += self.encoding._core_bpe.encode_single_piece(p.encode("utf-8"))
        return ids

    def pieces(self, text: str, start: int, stop: int) -> list[str]:
        """Matches from one boundary to another, seen with the text behind them."""
        out = []
        for m in self.pattern.finditer(text, start):
            if m.end() > stop:
                break
            out.append(m[0])
        return out

    def boundaries(self, text: str) -> list[int]:
        """Ends of the matches; the pattern covers every character."""
        return [m.end() for m in self.pattern.finditer(text)]


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(ranks_path, pattern)


def digests(enc: PieceEncoder, parts: list[list[int]]) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the joined ids, SHA-256 of the decoded bytes)."""
    joined, raw, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in parts:
        if not ids:
            continue
        if n:
            joined.update(b",")
        joined.update(",".join(map(enc.name, ids)).encode())
        raw.update(enc.encoding.decode_bytes(ids))
        n += len(ids)
    return n, joined.hexdigest(), raw.hexdigest()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode the ids again; one row (id, n_tokens, digests) per input row."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key_type = base.schema["doc_id"].dataType.simpleString()
    one_chunk = base.where(F.char_length("text") <= chunk)

    def whole_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path, pattern)
        for b in batches:
            rows = [digests(enc, [enc.chunk(t)]) for t in b["text"]]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    short = one_chunk.mapInPandas(whole_texts, f"doc_id {key_type}, {RESULT}")

    # ---- long texts: chunk rows dealt by (row, chunk) ----
    # The row key stays fixed from here on because the chunks are stored.
    long_docs = base.where(F.char_length("text") > chunk).withColumn("uid", F.expr("uuid()"))
    step = chunk - overlap
    n_chunks = F.greatest(F.ceil((F.char_length("text") - F.lit(overlap)) / F.lit(step)), F.lit(1)).cast("int")
    chunks = (
        long_docs.select("uid", "doc_id", "text", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("k"))
        .select("uid", "doc_id", "k", F.expr(f"substring(text, k * {step} + 1, {chunk})").alias("part"))
    )
    chunks = stored(chunks, "bpe-chunks")

    def seams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Boundaries of each chunk within its two overlaps, as positions in the text.

        Matches that end near the chunk's own end may change with what follows
        ("'r" before "e"), so those ends are left out."""
        enc = encoder(ranks_path, pattern)
        for b in batches:
            heads, tails = [], []
            for k, part in zip(b["k"], b["part"], strict=True):
                at = int(k) * step
                ends = [e for e in enc.boundaries(part) if e <= len(part) - LOOKAHEAD_CHARS]
                heads.append([at + e for e in ends if e < overlap])
                tails.append([at + e for e in ends if e >= step])
            yield pd.DataFrame({"uid": b["uid"], "k": b["k"], "head": heads, "tail": tails})

    n = shuffle_partitions(spark)
    bounds = (
        chunks.repartition(n, "uid", "k")
        .mapInPandas(seams, "uid string, k int, head array<int>, tail array<int>")
    )
    left = bounds.select("uid", "k", "tail")
    right = bounds.select("uid", (F.col("k") - 1).alias("k"), "head")
    seam = stored(
        left.join(right, ["uid", "k"]).select("uid", "k", F.array_min(F.array_intersect("tail", "head")).alias("cut")),
        "bpe-seams",
    )
    unsynced = seam.where(F.col("cut").isNull()).select("uid").distinct()
    starts = seam.select("uid", (F.col("k") + 1).alias("k"), F.col("cut").alias("from_cut"))
    ends = seam.select("uid", "k", F.col("cut").alias("to_cut"))
    pieces = (
        chunks.join(unsynced, "uid", "left_anti")
        .join(starts, ["uid", "k"], "left")
        .join(ends, ["uid", "k"], "left")
        .select(
            "uid", "doc_id", "k", "part",
            F.expr(f"coalesce(from_cut - k * {step}, 0)").alias("start"),
            F.expr(f"coalesce(to_cut - k * {step}, char_length(part))").alias("stop"),
        )
    )
    whole = long_docs_again(chunks, unsynced, overlap)

    def encode_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        enc = encoder(ranks_path, pattern)
        for b in batches:
            ids = [
                np.array(enc.encode(enc.pieces(t, i, j)), dtype="<u4").tobytes()
                for t, i, j in zip(b["part"], b["start"], b["stop"], strict=True)
            ]
            yield pd.DataFrame({"uid": b["uid"], "doc_id": b["doc_id"].array, "k": b["k"], "ids": ids})

    encoded = pieces.unionByName(whole).repartition(n, "uid", "k").mapInPandas(
        encode_parts, f"uid string, doc_id {key_type}, k int, ids binary")

    def join_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        enc = encoder(ranks_path, pattern)
        for b in batches:
            rows = []
            for parts in b["parts"]:
                lists = [np.frombuffer(p["ids"], dtype="<u4").tolist() for p in parts]
                rows.append(digests(enc, lists))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    gathered = (
        encoded.groupBy("uid").agg(
            F.first("doc_id").alias("doc_id"),
            F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select("doc_id", "parts")
    )
    long_rows = gathered.mapInPandas(join_parts, f"doc_id {key_type}, {RESULT}")
    return short.unionByName(long_rows)


def long_docs_again(chunks: DataFrame, unsynced: DataFrame, overlap: int) -> DataFrame:
    """Whole texts of the documents with a seam that found no common boundary."""
    own = F.expr(f"transform(parts, (p, i) -> if(i = 0, p.part, substring(p.part, {overlap} + 1)))")
    return (
        chunks.join(unsynced, "uid", "left_semi")
        .groupBy("uid")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
        .select("uid", "doc_id", F.lit(0).alias("k"), F.array_join(own, "").alias("part"))
        .withColumns({"start": F.lit(0), "stop": F.char_length("part")})
    )
