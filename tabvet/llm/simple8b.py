"""Simple-8b word-aligned coding of token ids (operator 5).

A 64-bit word holds a selector in its top four bits and up to sixty payload
bits.  Selector 1..14 packs 60, 30, 20 ... 1 values of 1, 2, 3 ... 60 bits;
selector 0 is the escape: the next word is one raw 64-bit value.  The last
word of a block may hold fewer values than its selector says (the count of
the block cuts it).  Every block keeps the output offset of every 256th word,
so any slice of a block decodes on its own, with numpy.

The file format is a table of blocks in the shared folder, written by Spark's
own committer: ``shard, block, start`` (ids of the shard before the block),
``n_ids``, ``doc_ids`` (int64, little-endian), ``nulls`` (positions of null
ids), ``lengths`` (ids per document) and ``words`` (both Simple-8b) and
``offsets``.  Shards are ranges of ascending ``doc_id``; a document never
leaves its block, and a block ends with the document that fills it.

Defined results: a null text is an empty text (only the end id); null ids come
first; equal ids are ordered by text; extra columns are ignored; an empty
table writes no block and gives an empty result.
"""

from __future__ import annotations

import array
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import shuffle_partitions, stored

#: (values per word, bits per value) of selector 1, 2, ...: every width that packs another count.
SELECTORS = sorted({60 // b: b for b in range(60, 0, -1)}.items(), reverse=True)
SELECTORS = [(n, 60 // n) for n, _ in SELECTORS]
ESCAPE = 0
#: Ids after which a block is closed, and words between two offsets.
BLOCK_IDS = 65_536
OFFSET_STEP = 256
#: Pieces whose ids a tokenizer worker keeps before it starts over.
CACHE_PIECES = 800_000

_CLASS_OF_SMALL = np.array([max(1, int(v).bit_length()) for v in range(1 << 16)], dtype=np.uint8)


def bit_widths(values: np.ndarray) -> np.ndarray:
    if values.size and int(values.max()) < 1 << 16:
        return _CLASS_OF_SMALL[values.astype(np.int64)]
    powers = np.array([1 << b for b in range(1, 64)], dtype=np.uint64)
    return (np.searchsorted(powers, values, side="right") + 1).astype(np.uint8)


def _runs(fits: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` values in a row fit from each position on (past the end: yes)."""
    padded = np.concatenate([fits, np.ones(n, dtype=bool)])
    have, ok = 1, padded
    while have < n:
        step = min(have, n - have)
        ok = ok[:-step] & ok[step:]
        have += step
    return ok[: len(fits)]


def encode(values: np.ndarray) -> np.ndarray:
    """Unsigned values to Simple-8b words."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n_values = len(v)
    if not n_values:
        return np.zeros(0, dtype=np.uint64)
    width = bit_widths(v)
    take = np.ones(n_values, dtype=np.uint8)
    choice = np.zeros(n_values, dtype=np.uint8)  # the escape, until a selector fits
    widest = int(width.max())
    for code in range(len(SELECTORS), 0, -1):
        n, bits = SELECTORS[code - 1]
        if bits >= widest:
            take[:], choice[:] = n, code
            continue
        ok = _runs(width <= bits, n)
        take[ok], choice[ok] = n, code
    steps, at, i = take.tobytes(), [], 0
    while i < n_values:
        at.append(i)
        i += steps[i]
    first = np.array(at, dtype=np.int64)
    codes = choice[first]
    place = np.arange(len(first)) + np.concatenate([[0], np.cumsum(codes == ESCAPE)[:-1]])
    words = np.zeros(len(first) + int((codes == ESCAPE).sum()), dtype=np.uint64)
    padded = np.concatenate([v, np.zeros(SELECTORS[0][0], dtype=np.uint64)])
    for code in np.unique(codes):
        own = codes == code
        if code == ESCAPE:
            words[place[own] + 1] = v[first[own]]
            continue
        n, bits = SELECTORS[code - 1]
        packed = np.full(int(own.sum()), np.uint64(int(code) << 60), dtype=np.uint64)
        for j in range(n):
            packed |= padded[first[own] + j] << np.uint64(j * bits)
        words[place[own]] = packed
    return words


def _counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selector and number of values of each word; a raw word after an escape has -1 and 0."""
    codes = (words >> np.uint64(60)).astype(np.int8)
    table = np.array([1] + [n for n, _ in SELECTORS] + [0], dtype=np.int64)
    if (codes == ESCAPE).any():
        # The word after an escape is raw whatever its top bits say.
        where = np.flatnonzero(codes == ESCAPE)
        last = -2
        for i in where.tolist():
            if i != last + 1:
                last = i
                if i + 1 < len(codes):
                    codes[i + 1] = -1
    counts = np.where(codes < 0, 0, table[np.maximum(codes, 0)])
    return codes, counts


def decode(words: np.ndarray, n_values: int) -> np.ndarray:
    """Simple-8b words to their first ``n_values`` values."""
    codes, counts = _counts(words)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(total, dtype=np.uint64)
    starts = ends - counts
    for code in np.unique(codes):
        own = np.flatnonzero(codes == code)
        if code == -1:
            continue
        if code == ESCAPE:
            out[starts[own]] = words[own + 1]
            continue
        n, bits = SELECTORS[code - 1]
        mask, w, s = np.uint64((1 << bits) - 1), words[own], starts[own]
        for j in range(n):
            out[s + j] = (w >> np.uint64(j * bits)) & mask
    return out[:n_values]


#: Set in an offset whose word is the raw word of an escape.
RAW_WORD = np.uint32(1 << 31)


def word_offsets(words: np.ndarray) -> np.ndarray:
    """Number of values before every ``OFFSET_STEP``-th word, marked where that word is raw."""
    codes, counts = _counts(words)
    before = np.concatenate([[0], np.cumsum(counts)])[:-1][::OFFSET_STEP].astype("<u4")
    return np.where(codes[::OFFSET_STEP] == -1, before | RAW_WORD, before).astype("<u4")


def decode_slice(words: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Values ``start:stop`` of a block; only the words between two offsets are decoded."""
    before = (offsets & ~RAW_WORD).astype(np.int64)
    lo = max(0, int(np.searchsorted(before, start, side="right")) - 1)
    hi = int(np.searchsorted(before, stop, side="left"))
    first = lo * OFFSET_STEP + int(offsets[lo] >= RAW_WORD)
    part = words[first: hi * OFFSET_STEP + 1]  # one more: an escape's raw word may lie behind the step
    if _counts(part)[0][-1] == ESCAPE:
        part = part[:-1]
    values = decode(part, stop - int(before[lo]))
    return values[start - int(before[lo]):]


class PieceTokenizer:
    """Ids of whole texts from a tokenizer that drops white space and ends each piece with an end-of-word token.

    White space never takes part in a token, so a text's ids are its words'
    ids in order.  Texts of ASCII and Latin-1 letters need no normalising but
    lower case; the tokenizer's own pattern cuts them into pieces (letters, one
    digit, other signs), and a worker asks the library once for each piece.
    Other texts go to the library as they are."""

    PLAIN = re.compile("[\t-\r\x20-\x7e\xc0-\xff]*")
    #: Pieces in one call's text: few enough for short texts, enough to spread the cost of a call.
    TOGETHER = 50

    def __init__(self, path: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # A text that holds the content of an added token goes to the library as it is: its pieces would be cut otherwise.
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The same pattern with the letters and digits of plain texts spelled out: twice as fast.
        plain = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x100))]
        for kind in (r"\p{L}", r"\p{N}"):
            split = split.replace(kind, "".join(c for c in plain if regex.fullmatch(kind, c)))
        self.pattern = re.compile(split)
        end = spec["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
        self.pieces: dict[str, bytes] = {}

    def _learn_pieces(self, pieces: list[str]) -> None:
        texts = [" ".join(pieces[i: i + self.TOGETHER]) for i in range(0, len(pieces), self.TOGETHER)]
        at = 0
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            own = pieces[at: at + self.TOGETHER]
            if len(cuts) != len(own):
                raise ValueError("the tokenizer does not end each piece with an end-of-word token")
            raw, start = ids.tobytes(), 0
            for p, stop in zip(own, (4 * cuts).tolist(), strict=True):
                self.pieces[p] = raw[start:stop]
                start = stop
            at += len(own)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [self.pattern.findall(low) if self.PLAIN.fullmatch(t) and not any(a in low for a in self.added) else None
                 for t, low in ((t, t.lower()) for t in texts)]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        pieces = self.pieces
        self._learn_pieces(list(set().union(*[ps for ps in plain if ps]).difference(pieces)))
        other = iter(self.tokenizer.encode_batch_fast(
            [t for t, ps in zip(texts, plain, strict=True) if ps is None], add_special_tokens=False))
        return [
            array.array("I", next(other).ids).tobytes() if ps is None else b"".join([pieces[p] for p in ps])
            for ps in plain
        ]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


BLOCK_SCHEMA = ("shard int, block int, start long, n_ids long, doc_ids binary, nulls binary,"
                " lengths binary, words binary, offsets binary")
#: Texts tokenised at once.
TEXTS_AT_ONCE = 256


def write_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every text, append ``end_id``, write the blocks in ascending id order; returns the written table."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = base.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.uint32(end_id).tobytes()

    def block(shard: int, number: int, start: int, ids: list, raw: list[bytes]) -> dict:
        lengths = np.array([len(r) // 4 for r in raw], dtype=np.uint64)
        words = encode(np.frombuffer(b"".join(raw), dtype="<u4"))
        return {
            "shard": shard, "block": number, "start": start, "n_ids": int(lengths.sum()),
            "doc_ids": np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes(),
            "nulls": np.array([k for k, i in enumerate(ids) if i is None], dtype="<u4").tobytes(),
            "lengths": encode(lengths).tobytes(), "words": words.tobytes(), "offsets": word_offsets(words).tobytes(),
        }

    def shard_blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tok, shard = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        number = start = held = 0
        ids: list = []
        raw: list[bytes] = []

        def close():
            nonlocal number, start, held, ids, raw
            b = block(shard, number, start, ids, raw)
            number, start, held, ids, raw = number + 1, start + b["n_ids"], 0, [], []
            return pa.RecordBatch.from_pylist([b], schema=arrow_schema)

        arrow_schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
            *[(c, pa.binary()) for c in ("doc_ids", "nulls", "lengths", "words", "offsets")]])
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                texts = batch.column(1).slice(lo, TEXTS_AT_ONCE).to_pylist()
                for key, own in zip(keys[lo: lo + TEXTS_AT_ONCE], tok.encode(texts), strict=True):
                    ids.append(key)
                    raw.append(own + end)
                    held += len(own) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield close()
        if ids:
            yield close()

    return stored(ranged.mapInArrow(shard_blocks, BLOCK_SCHEMA), "token-blocks")


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written blocks."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per shard, so at most as many as shuffle partitions.
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    placed = blocks.join(F.broadcast(shards), "shard").select(
        (F.col("shard_start") + F.col("start")).alias("start"), "n_ids", "doc_ids", "nulls", "lengths", "words")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                keys = np.frombuffer(b.doc_ids, dtype="<i8")
                lengths = decode(np.frombuffer(b.lengths, dtype="<u8"), len(keys)).astype(np.int64)
                ids = decode(np.frombuffer(b.words, dtype="<u8"), b.n_ids).astype("<u4")
                stops = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                doc_ids = pd.array(keys, dtype="Int64")
                doc_ids[np.frombuffer(b.nulls, dtype="<u4")] = pd.NA
                yield pd.DataFrame({
                    "doc_id": doc_ids, "start": b.start + stops - lengths, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(view[4 * (e - n): 4 * e]) for e, n in zip(stops, lengths, strict=True)],
                })

    return placed.mapInPandas(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
