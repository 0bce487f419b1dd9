"""HTML extraction with a linear-chain conditional random field (operator 6).

A page is the sequence of its DOM leaf blocks.  Each block has features of its
ancestors' tags, of their class, id and role names, and of its text (length,
share inside links, closing punctuation, neighbours' lengths).  The field has a
weight per feature and label, and one per pair of neighbouring labels; it is
trained by maximum likelihood on labelled pages, and the best label sequence of
a page is found by Viterbi.  The main text are the blocks labelled as article.

The labelled pages are made by a fixed generator (``labelled_page``): layouts
with semantic tags and with named ``div`` elements, menus, headers, footers,
sidebars, notices, adverts, forms, sharing links and reader comments.  Their
number is the bound ``TRAINING_PAGES``; the model is a few hundred weights.

Defined results: a null, empty or textless page has an empty text; broken
markup is read as far as it goes; null urls and ids are passed through; equal
pages get equal texts; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.html_blocks import Block, blocks, labelled_page

#: Labelled pages for training, the generator's seed, rounds of the optimiser and the ridge.
TRAINING_PAGES, SEED, ROUNDS, RIDGE = 800, 17, 200, 1e-3
#: Word counts at which the length feature changes.
LENGTHS = (1, 3, 6, 12, 25, 60, 150)


def _length(text: str) -> int:
    n = text.count(" ") + 1
    return sum(n > x for x in LENGTHS)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    lengths = [_length(b.text) for b in page]
    out = []
    for i, b in enumerate(page):
        own = {f"tag:{t}" for t in b.tags if t not in ("html", "body")}
        own |= {f"name:{n}" for n in b.names}
        own.add(f"leaf:{b.leaf}")
        own.add(f"length:{lengths[i]}")
        own.add(f"before:{lengths[i - 1] if i else 'none'}")
        own.add(f"after:{lengths[i + 1] if i + 1 < len(page) else 'none'}")
        own.add(f"linked:{0 if b.linked < 0.05 else 1 if b.linked < 0.5 else 2}")
        own.add(f"ends:{b.text[-1] in '.!?:'}")
        if "©" in b.text:
            own.add("sign:copyright")
        out.append(sorted(own))
    return out


@dataclass
class Field:
    """Weights: of features for label 1 over label 0, of label pairs, and of the first and last label."""

    weights: dict[str, float]
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emissions(self, page: list[Block]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in own) for own in features(page)]


def viterbi(scores: list[float], field: Field) -> list[int]:
    """The best label sequence; ``scores``: of label 1 over label 0 per block."""
    if not scores:
        return []
    (p00, p01), (p10, p11) = field.pairs.tolist()
    a, b = field.first[0], field.first[1] + scores[0]
    back = []
    for s in scores[1:]:
        from0, from1 = a + p00 >= b + p10, a + p01 >= b + p11
        back.append((0 if from0 else 1, 0 if from1 else 1))
        a, b = (a + p00 if from0 else b + p10), (a + p01 if from1 else b + p11) + s
    label = 0 if a + field.last[0] >= b + field.last[1] else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def likelihood(emissions: np.ndarray, labels: np.ndarray, mask: np.ndarray, pairs, first, last):
    """Sum of log-likelihoods of padded pages (pages x blocks), and its gradients."""
    n, t = emissions.shape
    e = np.zeros((n, t, 2))
    e[:, :, 1] = emissions
    ends = mask.sum(axis=1) - 1
    rows = np.arange(n)
    alpha = np.zeros((n, t, 2))
    beta = np.zeros((n, t, 2))
    alpha[:, 0] = first + e[:, 0]
    for i in range(1, t):
        step = np.logaddexp(alpha[:, i - 1, 0, None] + pairs[0], alpha[:, i - 1, 1, None] + pairs[1]) + e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    beta[rows, ends] = last
    for i in range(t - 2, -1, -1):
        ahead = e[:, i + 1] + beta[:, i + 1]
        step = np.logaddexp(pairs[:, 0] + ahead[:, 0, None], pairs[:, 1] + ahead[:, 1, None])
        inside = (np.arange(t)[i] < ends)[:, None]
        beta[:, i] = np.where(inside, step, beta[:, i])
    z = np.logaddexp(alpha[rows, ends, 0] + last[0], alpha[rows, ends, 1] + last[1])
    own = np.where(labels == 1, emissions, 0.0)
    score = (own * mask).sum(axis=1) + first[labels[:, 0]] + last[labels[rows, ends]]
    both = mask[:, 1:] & mask[:, :-1]
    score += (pairs[labels[:, :-1], labels[:, 1:]] * both).sum(axis=1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    d_emission = np.where(mask, labels - node[:, :, 1], 0.0)
    d_pairs = np.zeros((2, 2))
    for x in range(2):
        for y in range(2):
            edge = np.exp(alpha[:, :-1, x] + pairs[x, y] + e[:, 1:, y] + beta[:, 1:, y] - z[:, None])
            d_pairs[x, y] = (((labels[:, :-1] == x) & (labels[:, 1:] == y) & both) - edge * both).sum()
    d_first = np.array([(labels[:, 0] == x).sum() - node[:, 0, x].sum() for x in range(2)])
    d_last = np.array([(labels[rows, ends] == x).sum() - node[rows, ends, x].sum() for x in range(2)])
    return (score - z).sum(), d_emission, d_pairs, d_first, d_last


def label_blocks(page: list[Block], texts: list[str]) -> list[int]:
    """1 for the blocks that are the article's texts, matched in order."""
    out, at = [], 0
    for b in page:
        hit = at < len(texts) and b.text == " ".join(texts[at].split())
        out.append(int(hit))
        at += hit
    return out


def train(pages: list[tuple[str, list[str]]], rounds: int = ROUNDS, ridge: float = RIDGE) -> Field:
    """Maximum likelihood with a ridge, by Adam over all labelled pages."""
    read = [(p, label_blocks(p, texts)) for p, texts in ((blocks(h), t) for h, t in pages) if p]
    feats = [features(p) for p, _ in read]
    names = sorted({f for page in feats for own in page for f in own})
    index = {f: i for i, f in enumerate(names)}
    t = max(len(p) for p, _ in read)
    mask = np.zeros((len(read), t), dtype=bool)
    labels = np.zeros((len(read), t), dtype=int)
    x = np.zeros((sum(len(p) for p, _ in read), len(names)), dtype=np.float32)
    row = 0
    for i, (p, own) in enumerate(read):
        mask[i, :len(p)] = True
        labels[i, :len(p)] = own
        for fs in feats[i]:
            x[row, [index[f] for f in fs]] = 1
            row += 1
    theta = np.zeros(len(names) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, pairs, first, last = theta[:-8], theta[-8:-4].reshape(2, 2), theta[-4:-2], theta[-2:]
        e = np.zeros(mask.shape)
        e[mask] = x @ w.astype(np.float32)
        _, de, dp, df, dl = likelihood(e, labels, mask, pairs, first, last)
        g = np.concatenate([x.T @ de[mask].astype(np.float32), dp.ravel(), df, dl]) / len(read) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in index.items()}
    return Field(weights, theta[-8:-4].reshape(2, 2).copy(), theta[-4:-2].copy(), theta[-2:].copy())


@functools.cache
def default_field() -> Field:
    rng = random.Random(SEED)
    return train([labelled_page(rng) for _ in range(TRAINING_PAGES)])


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return " ".join(b.text for b, y in zip(page, viterbi(field.emissions(page), field), strict=True) if y)


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())  # some hundred weights
    base = pages.select("page_id", "url", "html")

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for b in batches:
            texts = [main_text(h, own) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return base.mapInArrow(rows, f"{kinds}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
