from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tabvet.llm import minhash_tensor
from tabvet.llm.minhash_tensor import band_keys, near_duplicates, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    """Every pair, on the shingles themselves."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    part = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both) and part[x] != part[y]:
                old, new = part[x], part[y]
                part = [new if p == old else p for p in part]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_against_every_pair(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (4, 9, 40, 300, 900):
        for rate in (0.0, 0.01, 0.03, 0.05, 0.06):
            base = [rng.choice(words) for _ in range(size)]
            texts += [" ".join(rng.choice(words) if rng.random() < rate else w for w in base) for _ in range(6)]
    passage = " ".join(rng.choice(words) for _ in range(150))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([10, 25, 37, 60]))) for _ in range(60)]
    texts += [t.upper() for t in texts[:10]] + ["", None, "   \n", "one", "ONE", "one two three", "One  two\tthree"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[0]), (None, texts[1]), (None, "alone without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near_duplicates(docs)) == expected(rows)


def test_chain_and_large_group(spark):
    """A chain links through its neighbours only; a large group of near copies is one component however often a copy repeats."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    chain = []
    for i in range(12):
        base[15 * i: 15 * i + 4] = [rng.choice(words) for _ in range(4)]
        chain.append(" ".join(base))
    core = [rng.choice(words) for _ in range(250)]
    group = []
    for _ in range(200):
        own = list(core)
        for _ in range(3):
            own[rng.randrange(250)] = rng.choice(words)
        group.append(" ".join(own))
    texts = [t for t in chain + group for _ in range(3)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(near_duplicates(docs)) == expected(rows)


def test_keys_tell_their_band_and_estimate_similarity():
    rng = np.random.default_rng(1)
    keys = band_keys(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    assert len(set(keys.tolist())) == len(keys) == 2 * minhash_tensor.BANDS
    # At a similarity of 0.8 a key of four minhashes agrees with a probability of 0.41.
    agree = []
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        agree.append((band_keys(s[:270]) == band_keys(s[30:])).mean())
    assert abs(np.mean(agree) - 0.8 ** 4) < 0.02


def test_no_linking_pair_misses_all_tables():
    rng = np.random.default_rng(2)
    for size in (9, 90, 900):
        for _ in range(400):
            s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            own = size // 9  # the sets share 8 of 10 parts of their union
            a, b = band_keys(s[:size - own]), band_keys(s[own:])
            half = minhash_tensor.BANDS
            assert (a[:half] == b[:half]).any() and (a[half:] == b[half:]).any()


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert result(near_duplicates(empty)) == []
    assert len(shingles(None)) == len(shingles("")) == len(shingles(" \n ")) == 0
    long_text = " ".join(f"t{i % 20011}" for i in range(120_000))
    rows = [(1, long_text, 5, 7), (2, long_text + " more", 5, 7), (3, None, None, None), (4, "node n first second", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, n int")
    assert result(near_duplicates(docs)) == expected([r[:2] for r in rows])


@pytest.mark.parametrize("text", ["a b", "a b c d", "É é É é"])
def test_only_ascii_is_lowered(text):
    assert len(shingles(text)) == len(set(expected_set(text)))


def expected_set(text):
    w = WORD.findall(text.translate(LOWER))
    return [tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
