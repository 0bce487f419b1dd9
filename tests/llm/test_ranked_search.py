from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tabvet.llm import ranked_search
from tabvet.llm.ranked_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, items, k=10):
    """The definition, with every score."""
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, query in asked.items():
        scores = []
        for doc_id, c in held:
            score = 0
            for t, times in query.items():
                if c[t]:
                    m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda r: r[:2])[:k], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(rng, n_docs, n_words):
    words = [f"{rng.choice(['Ä', 'x', 'Y', 'é'])}{i}" for i in range(n_words)]
    return [(i, rng.choice([" ", "-", ". "]).join(words[min(int(rng.expovariate(12 / n_words)), n_words - 1)] for _ in range(rng.choice([1, 12, 90, 300]))))
            for i in range(n_docs)]


@pytest.mark.parametrize(("group", "block"), [(ranked_search.GROUP, ranked_search.BLOCK_TERMS), (16, 100), (40, 1000)])
def test_against_every_score(spark, monkeypatch, group, block):
    monkeypatch.setattr(ranked_search, "GROUP", group)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    rng = random.Random(8)
    docs = corpus(rng, 400, 300)
    docs += [(d + 1000, t) for d, t in docs[:40]] + [(5, docs[3][1]), (None, docs[2][1]), (1, None), (2, ""), (3, "?! ")]
    items = [(i, t) for i, (_, t) in enumerate(corpus(rng, 40, 320))]
    items += [(3, "x1 x2 unheardof"), (50, None), (51, "unheardof"), (None, "x1 é7 x1"), (52, docs[9][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert result(ranked(frame, asked)) == expected(docs, items)
    assert result(ranked(frame, asked, k=1)) == expected(docs, items, 1)


def test_creation_stops():
    """Once the rest cannot reach the k-th score no accumulator is created, and the survivors' scores are exact."""
    rare, common = b"rare", b"common"
    docs = [(i, 10, {common: 1, **({rare: 2} if i % 10 == 0 else {})}) for i in range(1000)]
    group = ranked_search._Group(docs, {rare: 3000, common: 2}, 1000, 10_000)
    alive, score = group.ranked([(rare, 1), (common, 1)], 10, 1)
    assert list(alive) == list(range(0, 1000, 10))
    assert set(score) == {group.postings[rare][1][0] + group.postings[common][1][0]}


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    long_text = "word " * 200_000 + "rare"
    rows = [(1, long_text, 1, "x"), (2, "rare b", 2, "y"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, item string")
    assert result(ranked(none, asked)) == []
    assert result(ranked(docs, no_items)) == []
    queries = [(1, "rare word"), (2, "B")]
    assert result(ranked(docs, spark.createDataFrame(queries, "item_id long, text string"))) == expected([r[:2] for r in rows], queries)
