"""Ranked lexical search by accumulator-limited term-at-a-time evaluation (operator 13).

All documents are ranked for each query item by an integer form of BM25.

1. The query terms are put into blocks of at most about ``BLOCK_TERMS`` rows; each
   block is a stated set of queries against all documents.
2. One pass counts documents, terms and the documents of each query term, as one
   row of a task; from these come the weights.
3. In a second pass every task takes its documents in groups of ``GROUP``.  For each
   item the terms are taken rarest first.  While the best score that the remaining
   terms can still add reaches the score of the k-th best document, a term creates
   accumulators for the documents that hold it; after that it only updates the
   accumulators that exist, so every survivor's score is exact.  A document without
   an accumulator stays below the k-th score then, ties included.  The k-th best
   score of a task's earlier groups counts as well.
4. A task returns at most k rows per item; these are ranked in two steps.

Defined results: null and empty texts and texts without terms are in no result
and not counted; an item without terms, or with none that occurs, has no rows;
items with equal ids are one item with the terms of all; null item ids are one
item; documents with equal ids are ranked one by one, null ids last among equal
scores; extra columns are ignored; an empty table of either kind gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import stored

#: Rows (item, term) of a block of queries.
BLOCK_TERMS = 200_000
#: Documents, and query terms in them, that a task scores together.
GROUP, GROUP_TERMS = 4096, 2_000_000
#: Share of a group's documents from which a term's impacts are kept as a dense array.
DENSE = 8
#: Buckets of a task's results in the first ranking step.
BUCKETS = 64

#: Bytes of terms: ASCII letters (lower-cased), digits and all bytes of other code points; the rest separates.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, in UTF-8."""
    return text.encode("utf-8").translate(_FOLD).split(b" ") if text else []


def _counted(text: str | None) -> tuple[int, Counter]:
    found = Counter(terms(text))
    found.pop(b"", None)
    return sum(found.values()), found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, times) of all query items."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = [(item, term, times) for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                   for term, times in _counted(text)[1].items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())],
                names=["item", "term", "times"])

    found = items.select(F.col(item_col).cast("long"), F.col(text_col)).mapInArrow(rows, "item long, term binary, times long")
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


def _statistics(docs: DataFrame, wanted) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all terms, and the documents of each query term of the block."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = wanted.value
        n_docs = length = 0
        held: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                own = terms(text)
                n = len(own) - own.count(b"")
                n_docs += n > 0
                length += n
                held.update(known.intersection(own))
        names = [None, None, *held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([0, 1, *[2] * len(held)], pa.int32()), pa.array([n_docs, length, *held.values()], pa.int64())],
            names=["term", "kind", "n"])

    counted = docs.select("text").mapInArrow(rows, "term binary, kind int, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()  # a row per query term of the block
    by_kind = {r.kind: r.n for r in counted if r.kind < 2}
    return by_kind.get(0) or 0, by_kind.get(1) or 0, {bytes(r.term): r.n for r in counted if r.kind == 2}


class _Group:
    """Postings of a group of documents: of each query term the documents and what the term adds to their scores."""

    def __init__(self, docs: list, weights: dict[bytes, int], n_docs: int, length: int):
        self.size = len(docs)
        lists: dict[bytes, list] = {}
        for i, (_, n, held) in enumerate(docs):
            m = 25 + (75 * n * n_docs) // length
            for term, tf in held.items():
                lists.setdefault(term, []).append((i, tf, m))
        self.postings, self.dense, self.most = {}, {}, {}
        for term, rows in lists.items():
            at, tf, m = np.array(rows, dtype=np.int64).T
            adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            self.postings[term] = (at, adds)
            self.most[term] = max(int(adds.max()), 0)
            if len(at) * DENSE > self.size:
                self.dense[term] = np.zeros(self.size, dtype=np.int64)
                self.dense[term][at] = adds

    def ranked(self, query: list[tuple[bytes, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with an accumulator and their exact scores; ``query``: terms rarest first, with their repeats.

        ``least``: a score that the result is known to reach k times without this group."""
        query = [(t, times) for t, times in query if t in self.postings]
        rest = [0] * (len(query) + 1)
        for i in range(len(query) - 1, -1, -1):
            rest[i] = rest[i + 1] + query[i][1] * self.most[query[i][0]]
        score = np.zeros(self.size, dtype=np.int64)
        made = np.zeros(self.size, dtype=bool)
        at = 0
        while at < len(query) and rest[at] >= least:
            term, times = query[at]
            docs, adds = self.postings[term]
            score[docs] += times * adds
            made[docs] = True
            at += 1
            # The k-th partial score never falls; it is looked up only when it may end the creation.
            if at < len(query) and rest[at] < int(score.max()) and self.size > k:
                least = max(least, int(np.partition(score, self.size - k)[self.size - k]))
        alive = np.flatnonzero(made)
        found = score[alive]
        place = None
        for term, times in query[at:]:
            if term in self.dense:
                found += times * self.dense[term][alive]
            else:
                if place is None:
                    place = np.full(self.size, -1, dtype=np.int64)
                    place[alive] = np.arange(len(alive))
                docs, adds = self.postings[term]
                own = place[docs]
                found[own[own >= 0]] += times * adds[own >= 0]
        return alive, found


def _best(rows: list[tuple[int, float, int | None]], k: int) -> list:
    """The k first rows (score, id for the order, id)."""
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


def _scored(docs: DataFrame, block, k: int) -> DataFrame:
    """(item, doc_id, score): at most k rows per item and task, with the best documents of all among them."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, queries, n_docs, length = block.value
        best: dict = {item: [] for item, _ in queries}
        group: list = []
        held_terms = 0

        def score():
            postings = _Group(group, weights, n_docs, length)
            for item, query in queries:
                top = best[item]
                least = top[-1][0] if len(top) == k else 1
                alive, found = postings.ranked(query, k, least)
                good = np.flatnonzero(found >= least)
                if len(good) > k:  # ties with the k-th stay until ids decide
                    good = good[found[good] >= np.partition(found[good], len(good) - k)[len(good) - k]]
                if len(good):
                    new = [(int(found[i]), math.inf if group[alive[i]][0] is None else group[alive[i]][0], group[alive[i]][0]) for i in good]
                    best[item] = _best(top + new, k)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = _counted(text)
                own = {t: found[t] for t in weights.keys() & found.keys()}
                if own:
                    group.append((doc_id, n, own))
                    held_terms += len(own)
                    if len(group) >= GROUP or held_terms >= GROUP_TERMS:
                        score()
                        group, held_terms = [], 0
        if group:
            score()
        out = [(item, doc_id, score) for item, top in best.items() for score, _, doc_id in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "item long, doc_id long, score long")


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The query terms in blocks of bounded size; all terms of an item are in one block."""
    blocks = max(1, math.ceil(queries.count() / BLOCK_TERMS))
    for i in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()  # about BLOCK_TERMS rows


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for rows in _blocks(stored(_query_terms(items, item_col, query_col), "search-queries")):
        wanted = spark.sparkContext.broadcast(frozenset(bytes(r.term) for r in rows))
        n_docs, length, df = _statistics(base, wanted)
        weights = {term: weight(n_docs, n) for term, n in df.items()}
        of_item: dict = {}
        for r in rows:
            if bytes(r.term) in df:
                of_item.setdefault(r.item, []).append((bytes(r.term), r.times))
        queries = [(item, sorted(own, key=lambda t: (df[t[0]], t[0]))) for item, own in of_item.items()]
        block = spark.sparkContext.broadcast((weights, queries, n_docs, length))
        part = _scored(base, block, k)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "score"), F.lit(BUCKETS)))
    first = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The definition with every score, for small tables.
SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
queries AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) q
  GROUP BY item_id, term),
postings AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM queries) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, corpus GROUP BY term, n_docs),
adds AS (
  SELECT p.doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS a
  FROM postings p JOIN lengths USING (doc_id) JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(times * a) AS BIGINT) AS score FROM queries JOIN adds USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
           FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
