from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tabvet.llm import spelling
from tabvet.llm.spelling import near_in_range, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def expected(rows):
    """The definition, on every pair of words."""
    total = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, own in close.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def corpus(rng, n_docs, n_words):
    words = ["".join(rng.choice("abeÿéÀ") for _ in range(rng.choice([5, 6, 6, 7, 8, 11]))) for _ in range(n_words)]
    words += ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4)) for _ in range(n_words)]

    def word():
        w = words[min(int(rng.expovariate(8 / len(words))), len(words) - 1)]
        if rng.random() < 0.15:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", "x", w[at] + "a"]) + w[at + 1:]
        return w.upper() if rng.random() < 0.1 else w

    return [(i, rng.choice([" ", ", ", "\n", "1"]).join(word() for _ in range(rng.choice([1, 40, 400])))) for i in range(n_docs)]


@pytest.mark.parametrize(("range_words", "share"), [(spelling.RANGE_WORDS, spelling.SHARE), (16, 5)])
def test_against_every_pair(spark, monkeypatch, range_words, share):
    monkeypatch.setattr(spelling, "RANGE_WORDS", range_words)
    monkeypatch.setattr(spelling, "SHARE", share)
    rows = corpus(random.Random(4), 150, 150)
    rows += [(None, rows[1][1]), (7, None), (8, ""), (9, rows[9][1]), (9, rows[9][1]), (10, "chain " + "abcdefgh " * 200 + "abcdefgg " * 30 + "abcdeffg " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)
    assert result(variants(docs)) == want


def test_sorted_list_against_definition():
    rng = random.Random(3)
    for size in [1, 2, 5] + [250] * 25:
        words = sorted({"".join(rng.choice("abcÿé") for _ in range(rng.choice([6, 6, 7, 8, 9]))) for _ in range(size)})
        got = []
        for reverse in (False, True):
            keys = sorted((w[::-1] if reverse else w).encode("latin-1") for w in words)
            for q, t in near_in_range(keys, keys, reverse):
                got += [tuple(keys[i].decode("latin-1")[:: -1 if reverse else 1] for i in p) for p in zip(q, t, strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {(x, y) for x in words for y in words if near(x, y)}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert result(variants(empty)) == []
    long_word = "ab" * 3000
    rows = [(1, f"{long_word} " * 6 + f"{long_word}x " * 30, 1, "n"), (2, None, None, None), (3, "abcdef " * 4, 2, "word"), (None, "xyzxyz " * 5, 3, "key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    assert result(variants(docs)) == expected([r[:2] for r in rows])
