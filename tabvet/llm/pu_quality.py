"""Quality classifier by positive-unlabelled learning (operator 1).

Trusted positives are the training documents labelled good; the unlabelled
texts are all training documents, whatever their label.  Negative labels are
never used.  With class prior pi, margin f and logistic loss, training
minimises the non-negative unbiased risk

    pi * R+_P(f) + max(0, R-_U(f) - pi * R-_P(f)) + ridge / 2 * |w|^2

by Newton steps over all training documents: each task adds up its gradient
and Hessian (their size is the number of features squared), a line search
keeps the risk falling, and no sample is drawn.

The prior is estimated from the corpus: a first classifier (positives against
unlabelled) orders the texts; in any upper region the share of unlabelled texts
over the share of positives bounds pi from above, and the smallest upper
confidence limit of this ratio among regions with enough positives is the
estimate.

Features come from the text alone.  Defined results: null and blank texts get
a score like any other (all their ratios are 0); labels that are null, or of
unknown documents, are ignored, several labels of one document count as good
only if all are; null ids are never labelled; repeated rows are scored alike;
extra columns are ignored; without any positive every score is 0.5; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import stored

#: Newton rounds at most, ridge, and step lengths of the line search.
ROUNDS, RIDGE, STEPS = 12, 1e-4, (1.0, 0.5, 0.25, 0.1, 0.02)
#: Score from which a document is predicted to be good.
GOOD_FROM = 0.7
#: Bins of the score, least share of positives of a region, and standard errors added, in the prior's estimate.
PRIOR_BINS, PRIOR_SHARE, PRIOR_ERRORS = 1000, 0.2, 2.0

_SYMBOLS = [ord(c) for c in "#*$%&|<>~^=_{}[]\\@"]
_UPPER = list(range(65, 91))
_DIGITS = list(range(48, 58))
_SPACES = [32, 9, 10, 11, 12, 13]
N_RATIOS = 12
#: The ratios, the ratios against a tenth (cut at 1), log length and the constant.
N_FEATURES = 2 * N_RATIOS + 2


def ratios(text: str | None) -> list[float]:
    """Twelve shares between 0 and 1 that are low for prose."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return [0.0] * N_RATIOS + [0.0]
    n = len(words)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    chars = max(1, len(data) - int(count[_SPACES].sum()))
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=n)
    distinct = len(np.unique(ids))
    repeated = 0
    if n >= 3:
        u = ids.view(np.uint64)
        win = (u[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ u[1:-1]) * np.uint64(0xD6E8FEB86659FD93) ^ u[2:]
        _, back, times = np.unique(win, return_inverse=True, return_counts=True)
        at = times[back] > 1
        mark = np.zeros(n, dtype=bool)
        for k in range(3):
            mark[k: n - 2 + k] |= at
        repeated = int(mark.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        min(1.0, int(count[_SYMBOLS].sum()) / n), min(1.0, int(count[124]) / n), min(1.0, int(count[33]) / n),
        min(1.0, int(count[_UPPER].sum()) / chars), int(count[_DIGITS].sum()) / chars,
        1.0 - len(set(lines)) / max(1, len(lines)), repeated / n,
        float((ids[1:] == ids[:-1]).sum()) / n, max(0.0, 1.0 - distinct / min(n, 60)),
        max(0.0, 1.0 - distinct / n) ** 4, sum(len(w) > 30 for w in words) / n, min(1.0, int(count[63] + count[59] + count[58]) / n),
        min(1.0, np.log1p(n) / 10.0),
    ]


def features(texts: list[str | None]) -> np.ndarray:
    r = np.array([ratios(t) for t in texts], dtype=np.float64).reshape(-1, N_RATIOS + 1)
    x = np.ones((len(r), N_FEATURES))
    x[:, :N_RATIOS] = r[:, :N_RATIOS]
    x[:, N_RATIOS: 2 * N_RATIOS] = np.minimum(1.0, 10.0 * r[:, :N_RATIOS])
    x[:, 2 * N_RATIOS] = r[:, N_RATIOS]
    return x


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are for testing only."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                x = features(part.column(1).to_pylist()).astype(np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, x array<float>")


@dataclass
class Model:
    """Weights of the margin and the estimated class prior; ``weights`` is None without positives."""

    weights: np.ndarray | None
    prior: float


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_FEATURES)


def _sums(train: DataFrame, fn) -> np.ndarray:
    """Sum over all rows of ``fn(x, positive)``, a vector: one vector per task, added up position by position."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                own = fn(_matrix(b.column(0)), np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=bool))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = train.select("x", "positive").mapInArrow(rows, "v array<double>")
    got = parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()  # as many rows as positions
    out = np.zeros(len(got))
    for r in got:
        out[r.pos] = r.s
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _risk_terms(x: np.ndarray, positive: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    """Per point: sums of the losses log(1 + e^-f) and log(1 + e^f) over positives, and of the latter over all."""
    out = []
    for w in points:
        f = x @ w
        low, high = np.logaddexp(0, -f), np.logaddexp(0, f)
        out += [low[positive].sum(), high[positive].sum(), high.sum()]
    return np.array(out)


def _newton(train: DataFrame, n_all: int, n_pos: int, slopes, value) -> np.ndarray:
    """Damped Newton steps; ``slopes(w)`` gives gradient and Hessian, ``value`` the risk from its three mean losses."""
    w = np.zeros(N_FEATURES)
    ridge = RIDGE * np.eye(N_FEATURES)
    ridge[-1, -1] = 1e-9
    for _ in range(ROUNDS):
        gradient, hessian = slopes(w)
        step = np.linalg.solve(hessian + ridge, gradient + ridge @ w)
        points = [w, *[w - t * step for t in STEPS]]
        s = _sums(train, lambda x, p, points=points: _risk_terms(x, p, points)).reshape(-1, 3) / [n_pos, n_pos, n_all]
        risks = [value(*r) + q @ ridge @ q / 2 for r, q in zip(s, points, strict=True)]
        i = int(np.argmin(risks))
        if i == 0 or risks[0] - risks[i] < 1e-7:
            return w if i == 0 else points[i]
        w = points[i]
    return w


def fit(train: DataFrame) -> Model:
    """``train``: (x, positive) of all training documents."""
    n_all, n_pos = (int(v) for v in train.agg(F.count(F.lit(1)), F.count_if("positive")).collect()[0])
    if not n_pos:
        return Model(None, 0.5)
    d = N_FEATURES

    def blocks(x, p, w):
        f = _sigmoid(x @ w)
        s = f * (1 - f)
        own = x[p]
        return np.concatenate([
            (f[:, None] * x).sum(0), ((s[:, None] * x).T @ x).ravel(), own.sum(0),
            (f[p][:, None] * own).sum(0), ((s[p][:, None] * own).T @ own).ravel(),
            [np.logaddexp(0, x @ w).sum(), np.logaddexp(0, own @ w).sum()]])

    def parts(w):
        v = _sums(train, lambda x, p: blocks(x, p, w))
        cut = np.cumsum([d, d * d, d, d, d * d, 2])
        gu, hu, mp, gp, hp, loss = np.split(v, cut[:-1])
        return gu / n_all, hu.reshape(d, d) / n_all, mp / n_pos, gp / n_pos, hp.reshape(d, d) / n_pos, loss[0] / n_all, loss[1] / n_pos

    # Positives against unlabelled, both of weight one half: only its order of the texts is used.
    def ordering(w):
        gu, hu, mp, gp, hp, _, _ = parts(w)
        return (gu + gp - mp) / 2, (hu + hp) / 2

    first = _newton(train, n_all, n_pos, ordering, lambda low_p, high_p, high_u: (low_p + high_u) / 2)
    prior = _prior(train, first)

    def risk(w):
        gu, hu, mp, gp, hp, high_u, high_p = parts(w)
        if high_u - prior * high_p >= 0:
            return gu - prior * mp, hu  # R+ and R- of the positives differ by the margin itself
        return prior * (gp - mp), prior * hp

    weights = _newton(train, n_all, n_pos, risk,
                      lambda low_p, high_p, high_u: prior * low_p + max(0.0, high_u - prior * high_p))
    return Model(weights, prior)


def _prior(train: DataFrame, w: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive shares over upper regions of the order by ``w``."""

    def histogram(x, p):
        b = np.minimum((_sigmoid(x @ w) * PRIOR_BINS).astype(int), PRIOR_BINS - 1)
        return np.concatenate([np.bincount(b, minlength=PRIOR_BINS), np.bincount(b[p], minlength=PRIOR_BINS)]).astype(float)

    v = _sums(train, histogram)
    upper = v.reshape(2, -1)[:, ::-1].cumsum(axis=1)
    share = upper / upper[:, -1:]
    ok = share[1] >= PRIOR_SHARE
    ratio = share[0][ok] / share[1][ok]
    # The smallest of many noisy ratios is too small: each one counts with its upper confidence limit.
    error = np.sqrt(((1 - share[:, ok]) / np.maximum(upper[:, ok], 1.0)).sum(axis=0))
    return float(np.clip((ratio * (1 + PRIOR_ERRORS * error)).min(), 1e-3, 1 - 1e-3))


def scores(table: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from a feature table."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = np.full(b.num_rows, 0.5) if model.weights is None else _sigmoid(_matrix(b.column(1)) @ model.weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(rows, f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, and the model."""
    table = stored(feature_table(docs), "quality-features")
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("l_id")).agg((F.min("quality") == 1).alias("good"))
    )
    train = table.where(~held_out(F.col("doc_id"))).join(known.where("good"), F.col("doc_id") == F.col("l_id"), "left").select(
        "x", F.col("l_id").isNotNull().alias("positive"))
    model = fit(stored(train, "quality-train"))
    out = scores(table, model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")), model
