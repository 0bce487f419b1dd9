from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tabvet.llm import pu_quality
from tabvet.llm.pu_quality import classified, fit, ratios

BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    out, model = classified(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [(quality[i], r.predicted) for i, r in rows.items() if r.held_out and i in quality]
    assert sum(q == p for q, p in held) / len(held) >= 0.95
    share = sum(quality.values()) / len(quality)
    assert abs(model.prior - share) < 0.12


def test_negative_and_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    only = labels.where("quality = 1").where(~pu_quality.held_out(F.col("doc_id")))
    extra = spark.createDataFrame([(10**9, 1, 0), (None, 1, 0), (3, None, 0)], labels.schema)
    a = {r.doc_id: r.score for r in classified(docs, labels)[0].collect()}
    b = {r.doc_id: r.score for r in classified(docs.withColumn("x", F.lit(1)).drop("lang"), only.unionByName(extra))[0].collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_newton_reaches_the_minimum(spark):
    """Against plain gradient descent on the same risk, all rows in one place."""
    rng = np.random.default_rng(1)
    x = np.zeros((3000, pu_quality.N_FEATURES))
    x[:, -1] = 1
    good = rng.random(3000) < 0.7
    x[:, :3] = rng.normal(0, 0.3, (3000, 3)) + np.where(good, 0.0, 0.8)[:, None]
    positive = good & (rng.random(3000) < 0.3)
    train = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive, strict=True)], "x array<float>, positive boolean").repartition(3)
    model = fit(train)
    assert abs(model.prior - good.mean()) < 0.08

    x = x.astype(np.float32).astype(float)

    def risk(w):
        f = x @ w
        high = np.logaddexp(0, f)
        part = max(0.0, high.mean() - model.prior * high[positive].mean())
        return model.prior * np.logaddexp(0, -f)[positive].mean() + part + pu_quality.RIDGE / 2 * (w[:-1] @ w[:-1])

    w, rate = np.zeros(x.shape[1]), 2.0
    for _ in range(6000):
        f = 1 / (1 + np.exp(-(x @ w)))
        g = (f[:, None] * x).mean(0) - model.prior * x[positive].mean(0) + pu_quality.RIDGE * np.append(w[:-1], 0)
        w -= rate * g
    assert risk(model.weights) <= risk(w) + 1e-4


def test_edge_texts_and_empty_tables(spark):
    assert all(0 <= v <= 1 for t in (None, "", " \n", "a", "!!! ### |||", "é" * 9, "w " * 50_000, "x" * 100_000) for v in ratios(t))
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "w " * 20_000), (3, "w " * 20_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in classified(docs, none)[0].collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], none.schema)
    assert all(0 <= r.score <= 1 for r in classified(docs, some)[0].collect())
    assert classified(docs.where(F.lit(False)), some)[0].count() == 0
