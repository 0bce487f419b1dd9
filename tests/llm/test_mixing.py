from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabvet.llm.mixing import allocate, mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_targets(size_of):
    """The resharing rule, step by step."""
    order = sorted((s for s in size_of if s is not None)) + ([None] if None in size_of else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = float(sum(size_of.values())), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(3.0 * size_of[s] for s in full)
        target = {s: 3.0 * size_of[s] for s in full}
        target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s for s in rest if target[s] > 3.0 * size_of[s] * (1 + 1e-12)}
        if not above:
            return target
        full |= above


def dual_rate(sizes, target):
    scale = sum(sizes) / len(sizes)
    lo, hi = -1e6, 1e6
    rate = lambda lam, n: min(3.0, math.exp(min(50.0, max(-700.0, lam * n / scale))))
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * rate(mid, n) for n in sizes) < target else (lo, mid)
    return lambda n: rate(lo, n) if n else 0.0


def check(rows, slack):
    """rows: (doc_id, text, source, mix_size, mix_source_size, mix_target, mix_copies)."""
    own = defaultdict(list)
    for r in rows:
        assert r.mix_size == len(WORD.findall(r.text or ""))
        own[r.source].append(r)
    size_of = {s: sum(r.mix_size for r in rs) for s, rs in own.items()}
    want = shared_targets(size_of)
    for s, rs in own.items():
        assert all(r.mix_source_size == size_of[s] for r in rs)
        assert all(r.mix_target == pytest.approx(want[s]) for r in rs)
        taken = sum(r.mix_copies * r.mix_size for r in rs)
        assert abs(taken - want[s]) <= max(slack * want[s], min((r.mix_size for r in rs if r.mix_size), default=0)), s
        if want[s]:
            rate = dual_rate([r.mix_size for r in rs], want[s])
            moved = [r for r in rs if not rate(r.mix_size) - 1.001 < r.mix_copies < rate(r.mix_size) + 1.001]
            assert not moved
    assert all(0 <= r.mix_copies <= 3 for r in rows)


def test_query_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # fifty documents per source
    rows = allocate(docs).collect()
    assert len(rows) == docs.count()
    check(rows, 0.01)
    again = {r.doc_id: r.mix_copies for r in allocate(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.mix_copies for r in rows}
    copies = Counter(r.doc_id for r in mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.mix_copies for r in rows if r.mix_copies})


def test_nulls_ties_repeated_rows_and_hot_classes(spark):
    rows = [(i, "w " * (1 + i % 40), "a") for i in range(400)]
    rows += [(1000 + i, "same size here", "hot") for i in range(2500)] + [(7, "x y", None)] * 9 + [(None, None, None), (8, "", "zero")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n long, target int")
    out = allocate(docs)
    assert out.columns[:5] == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    check(got, 0.01)
    assert mixed(docs).columns == docs.columns
    assert sum(r.mix_copies for r in got) == mixed(docs).count()


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [(r.mix_target, r.mix_copies) for r in allocate(docs).collect()] == [(0.0, 0)] * 2
    assert allocate(docs.where(F.lit(False))).count() == 0
    assert mixed(docs).count() == 0
