from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tabvet.llm import quality_rules
from tabvet.llm.quality_rules import binomial_tail, cutoffs, judged, kept_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = "/root/testdata/sf0.01"


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    under = {j for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(under) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(under), failed)


def got(df):
    return sorted(((r.doc_id, *(tuple(r)[1:7])) for r in df.collect()), key=str)


def test_base_counts(spark):
    rng = random.Random(6)
    bits = ["a", "b", "c", "é", "#x", "||", "\n", "\n\n", "\t", "\x0b", " ", "<b>", "a.", "😀"]
    texts = [None, "", " ", "\n", "a b", "a b a b a b", "a a a a", "x" * 30_000, "the same line\n" * 400, "w " * 3000]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", 5, 6) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, n_words int, q_words int")
    labels = spark.createDataFrame([(0, 1), (None, 1), (1, None), (3, 0)], "doc_id long, quality int")
    out = judged(docs, labels)
    assert got(out) == sorted(((i, *counts(t)) for i, t in enumerate(texts)), key=str)
    assert all(r.kept == (not r.base_failed) for r in out.collect())  # no cutoff is safe with one label
    assert kept_documents(docs, labels).schema == docs.schema
    assert judged(docs.where(F.lit(False)), labels).count() == 0
    assert judged(docs.drop("lang"), labels.where(F.lit(False))).count() == len(texts)


def exact_tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))
               for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 5, 17, 100, 830, 20_000, 400_000) for k in {0, 1, 3, n // 200, n // 60, n // 51} if k < 0.02 * n]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", binomial_tail(F.col("n"), F.col("k"), 0.02))
    for r in df.collect():
        assert math.isclose(r.p, exact_tail(r.n, r.k, 0.02), rel_tol=1e-7, abs_tol=1e-300), r
    assert spark.range(1).select(binomial_tail(F.lit(10), F.lit(5), 0.02)).collect()[0][0] == 1.0


def test_cutoffs_are_admissible(spark):
    rng = random.Random(3)
    n_rules = len(quality_rules.RULES)
    rows = []
    for i in range(6000):
        good = i % 5 != 0
        r = [0.0] * n_rules
        r[0] = rng.random() * 0.3 if good else 0.6 + rng.random()
        r[1] = rng.random()  # useless
        r[2] = 0.9 if good and i % 20 == 1 else (0.0 if good else 0.95)  # catches junk, but 6 % of the good ones
        rows.append((i % 2, r, good))
    table = cutoffs(spark.createDataFrame(rows, "q_stratum int, q_ratios array<double>, good boolean")).collect()
    assert {r.c_stratum for r in table} == {0, 1}
    tests = (len(quality_rules.STRATA) + 1) * n_rules * len(quality_rules.CUTOFFS)
    for t in table:
        own = [r for s, r, g in rows if g and s == t.c_stratum]
        assert 0.3 <= t.c_cutoffs[0] <= 0.6 and math.isinf(t.c_cutoffs[1])
        for i, c in enumerate(t.c_cutoffs):
            if not math.isinf(c):
                k = sum(r[i] > c for r in own)
                assert exact_tail(len(own), k, quality_rules.ALPHA) <= quality_rules.DELTA / tests


def test_query_on_labelled_documents(spark):
    from tabvet.llm.q_quality import op3_quality_rules

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    out = op3_quality_rules(spark, BIG)
    assert got(out) == sorted(((i, *counts(t)) for i, t in texts.items()), key=str)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    judged_good = [r for r in out.collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in judged_good) <= quality_rules.ALPHA * len(quality_rules.RULES) * len(judged_good)
