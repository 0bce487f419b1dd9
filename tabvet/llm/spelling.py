"""Spelling variant grouping by dynamic programming over the sorted vocabulary (operator 12).

Words are counted over the whole corpus; two words are near when exactly one
code point is inserted, deleted or replaced.

1. Every task counts the words of its texts and emits partial counts, which
   Spark adds up; what stands often enough is the vocabulary.
2. The vocabulary is sorted twice, as it is and with each word reversed, and cut
   into ranges of some thousand words.  Of two near words the first half or,
   reversed, the first half of the reversed words is equal (``half``), so each
   pair is found in exactly one of the two orders.
3. A word is sent to the ranges that hold words with its first half, unless the
   prefix that all words of a range share is already more than one edit away.
4. In a range all words sent to it go down the sorted list together.  The banded
   row (three cells) of a prefix is computed once for all words that share it, as
   the longest common prefixes of neighbours tell; a prefix whose row exceeds one
   edit is left with all words that start with it.
5. A word's form is its near word of largest count, if that is large enough;
   roots follow by pointer jumping, counts grow at each step.

Defined results: null and empty texts have no words; a null id counts as the
empty string in the hash; repeated rows count again; words of any length; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import stored

#: Lower-cased runs of at least LENGTH code points; in UTF-8 U+00C0 to U+00FF are the byte C3 and one of 80 to BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){6,}")
#: A word is damaged where this divides the hash of its document and itself.
DAMAGE = 199
#: Code points and occurrences of a word, and how much more frequent a form is.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: Words of a range, unless that gives more than RANGES of them.
RANGE_WORDS, RANGES = 4096, 8192
#: Words that are taken down a range together, and words of one task's share of a range.
TOGETHER, SHARE = 8192, 65_536
#: Entries of a task's counter before it is emitted.
COUNTED = 400_000


def runs(text: str | None, doc_id: int | None) -> Counter:
    """The lower-cased runs of a text that can be words, with their occurrences, damaged ones as damaged."""
    found = Counter(_RUN.findall(text.encode("utf-8").lower())) if text else Counter()
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    damaged = [(run, h) for run in found if not (h := zlib.crc32(run, start)) % DAMAGE]
    taken = [(run.decode("utf-8"), h, found.pop(run)) for run, h in damaged]
    for run, h, n in taken:  # what comes out is not damaged again
        at = h % len(run)
        found[(run[:at] + run[at + 1:]).encode("utf-8")] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()

        def counts():
            words = [w.decode("utf-8") for w in total]
            kept = [(w, n) for w, n in zip(words, total.values(), strict=True) if len(w) >= LENGTH]
            total.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for run, n in runs(text, doc_id).items():
                    total[run] += n
                if len(total) > COUNTED:
                    yield counts()
        yield counts()

    counted = docs.mapInArrow(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def half(length: int) -> int:
    """Code points of the half by which pairs are dealt to the two orders; ``length`` is that of the shorter word."""
    return length // 2


def _ranges(words: DataFrame) -> tuple[DataFrame, list]:
    """(side, part, key, n) of both orders, cut into ranges, and the first and last key of every range."""
    n_words = words.count()
    size = max(RANGE_WORDS, -(-2 * n_words // RANGES))
    sides = words.select(F.lit(0).alias("side"), F.col("word").alias("key"), "n").unionByName(
        words.select(F.lit(1).alias("side"), F.reverse("word").alias("key"), "n"))
    cut = sides.repartitionByRange(max(1, -(-2 * n_words // size)), "side", "key").withColumn("part", F.spark_partition_id())
    cut = stored(cut, "spelling-ranges")
    ends = cut.groupBy("side", "part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("side", "first")
    return cut, [tuple(r) for r in ends.collect()]  # some 2 * RANGES rows at most


def _next_row(row, t: int, q: bytes, d: int):
    """The banded row of a prefix one code point longer: edits between it (d + 1 long, last ``t``) and
    the first d, d + 1 and d + 2 code points of ``q``; 2 stands for more than one."""
    a, b, c = row
    far = 2
    x = min(a + (t != q[d - 1]), b + 1) if 0 < d <= len(q) else (b + 1 if d == 0 else far)
    y = min(b + (t != q[d]), c + 1, x + 1) if d < len(q) else far
    z = min(c + (t != q[d + 1]), y + 1) if d + 1 < len(q) else far
    return min(x, far), min(y, far), min(z, far)


def _reachable(prefix: bytes, q: bytes) -> bool:
    """Whether a word that starts with ``prefix`` can be within one edit of ``q``."""
    row = (2, 0, 1)
    for d, t in enumerate(prefix):
        row = _next_row(row, t, q, d)
        if min(row) > 1:
            return False
    return True


def _routed(cut: DataFrame, ends: list) -> DataFrame:
    """(side, part, key) of every word and every range that may hold near words of it."""
    import os.path

    table = {}
    for side in (0, 1):
        own = [(part, first.encode("latin-1"), last.encode("latin-1")) for s, part, first, last in ends if s == side]
        table[side] = (own, [f for _, f, _ in own], [os.path.commonprefix([f, t]) for _, f, t in own])
    held = cut.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator) -> Iterator:
        from bisect import bisect_right

        import pyarrow as pa

        for b in batches:
            out = []
            for side, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, firsts, shared = held.value[side]
                q = key.encode("latin-1")
                start = q[: half(max(LENGTH, len(q) - 1))]
                at = max(0, bisect_right(firsts, start) - 1)
                while at < len(own) and (own[at][1] < start or own[at][1].startswith(start)):
                    if own[at][2] >= start and _reachable(shared[at], q):
                        out.append((side, own[at][0], key))
                    at += 1
            kinds = (pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(3)], names=["side", "part", "key"])

    return cut.select("side", "key").mapInArrow(rows, "side int, part int, key string")


def near_in_range(targets: list[bytes], queries: list[bytes], reverse: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, target) of near words in a sorted list, of those pairs that this order has to find."""
    lengths = np.array([len(t) for t in targets], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    chars = np.frombuffer(b"".join(targets) + b"\0", dtype=np.uint8).astype(np.int16)
    lcp = np.zeros(len(targets) + 1, dtype=np.int64)  # lcp[0] and lcp[-1] stay 0
    for i in range(1, len(targets)):
        a, b, k = targets[i - 1], targets[i], 0
        while k < len(a) and k < len(b) and a[k] == b[k]:
            k += 1
        lcp[i] = k
    for at in range(0, len(queries), TOGETHER):
        for q, t in _descended(lengths, starts, chars, lcp, targets, queries[at: at + TOGETHER], reverse):
            yield q + at, t


def _descended(lengths, starts, chars, lcp, targets, queries, reverse):
    from bisect import bisect_left

    n_q = np.array([len(q) for q in queries], dtype=np.int64)
    q_starts = np.concatenate([[0], np.cumsum(n_q)])
    q_chars = np.frombuffer(b"".join(queries) + b"\0", dtype=np.uint8).astype(np.int16)
    depth0 = np.maximum(LENGTH, n_q - 1) // 2
    low = np.array([bisect_left(targets, q[:d]) for q, d in zip(queries, depth0, strict=True)], dtype=np.int64)
    longest = b"\xff" * (int(lengths.max(initial=0)) + 1)  # behind every word with the same first half
    high = np.array([bisect_left(targets, q[:d] + longest) for q, d in zip(queries, depth0, strict=True)], dtype=np.int64)
    go = high > low

    def q_char(q, j):
        """Code point j of each query; -1 outside."""
        ok = (j >= 0) & (j < n_q[q])
        return np.where(ok, q_chars[np.where(ok, q_starts[q] + j, 0)], -1)

    # Rows of the queries that stand at prefixes of d code points: query, range of words with that prefix, three cells.
    state = [np.zeros(0, dtype=np.int64)] * 6
    last = int(min(lengths.max(initial=0), n_q.max(initial=0) + 1))
    for d in range(int(depth0.min(initial=0)), last + 1):
        new = np.flatnonzero(go & (depth0 == d))
        one, zero = np.ones(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64)
        state = [np.concatenate(c) for c in zip(state, (new, low[new], high[new], one, zero, one), strict=True)]
        q, lo, hi, a, b, c = state
        if not len(q):
            continue
        # A word that ends here is the first of its range: its distance stands in the cell of the query's length.
        off = n_q[q] - d
        cell = np.where(off == -1, a, np.where(off == 0, b, np.where(off == 1, c, 2)))
        end = np.flatnonzero((lengths[lo] == d) & (cell == 1))
        if len(end):
            yield _of_this_order(q[end], lo[end], off[end], lengths, starts, chars, n_q, q_char, reverse)
        # The next prefixes: where neighbours have fewer than d + 1 code points in common, among words that are long enough.
        heads = np.flatnonzero((lcp[:-1] <= d) & (lengths > d))
        left, right = np.searchsorted(heads, lo), np.searchsorted(heads, hi)
        times = right - left
        of = np.repeat(np.arange(len(q)), times)
        child = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + left[of]
        bounds = np.append(heads, len(lengths))
        lo2 = heads[child]
        # The range ends at the next prefix or with its parent's.
        hi2 = np.minimum(bounds[child + 1], hi[of])
        q, a, b, c = q[of], a[of], b[of], c[of]
        t = chars[starts[lo2] + d]
        x = np.where(d <= n_q[q], np.minimum(a + (t != q_char(q, d - 1)), b + 1), 2)
        y = np.where(d < n_q[q], np.minimum(np.minimum(b + (t != q_char(q, d)), c + 1), x + 1), 2)
        z = np.where(d + 1 < n_q[q], np.minimum(c + (t != q_char(q, d + 1)), y + 1), 2)
        near = (x < 2) | (y < 2) | (z < 2)
        state = [v[near] for v in (q, lo2, hi2, np.minimum(x, 2), np.minimum(y, 2), np.minimum(z, 2))]


def _of_this_order(q, t, off, lengths, starts, chars, n_q, q_char, reverse):
    """Of the pairs those that this order has to find: as they are, the first half of the shorter word is shared;
    reversed, it is not shared from the word's other end."""
    short = np.minimum(n_q[q], lengths[t])
    keep = np.ones(len(q), dtype=bool)
    h = short // 2
    for j in range(int(h.max(initial=0))):
        if reverse:  # the first code points of the words stand at the end of the reversed keys
            same = q_char(q, n_q[q] - 1 - j) == chars[starts[t] + np.maximum(lengths[t] - 1 - j, 0)]
        else:
            same = q_char(q, np.full(len(q), j)) == chars[starts[t] + np.minimum(j, lengths[t] - 1)]
        keep &= same | (j >= h)
    keep = ~keep if reverse else keep
    return q[keep], t[keep]


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of the vocabulary ``words`` (word, n)."""
    cut, ends = _ranges(words)
    routed = stored(_routed(cut, ends), "spelling-routed")
    shares = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares")).where("shares > 1")  # a row of a range at most
    share = F.coalesce(F.col("shares"), F.lit(1)).cast("int")
    queries = routed.join(F.broadcast(shares), "part", "left").select(
        "side", "part", F.pmod(F.xxhash64("key"), share).cast("int").alias("share"), "key")
    targets = cut.join(F.broadcast(shares), "part", "left").select(
        "side", "part", F.explode(F.sequence(F.lit(0), share - 1)).alias("share"), "key", "n")

    def scanned(left, right):
        import pyarrow as pa

        left, right = left.to_pydict(), right.to_pydict()
        word, near, near_n = [], [], []
        for side in (0, 1):  # a range at the border holds words of both orders
            own = sorted((k, n) for s, k, n in zip(left["side"], left["key"], left["n"], strict=True) if s == side)
            names = sorted(k for s, k in zip(right["side"], right["key"], strict=True) if s == side)
            if not own or not names:
                continue
            for i, j in near_in_range([k.encode("latin-1") for k, _ in own], [k.encode("latin-1") for k in names], side == 1):
                step = -1 if side else 1
                word += [names[x][::step] for x in i]
                near += [own[x][0][::step] for x in j]
                near_n += [own[x][1] for x in j]
        return pa.table({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})

    return (
        targets.groupBy("part", "share").cogroup(queries.groupBy("part", "share"))
        .applyInArrow(scanned, "word string, near string, near_n long")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer jumping: a step at least doubles the way."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = stored(vocabulary(base), "spelling-words")
    # The largest count first, of equal ones the smallest word: Spark orders strings by code point.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    named = stored(
        words.join(near, "word", "left").select(
            "word", form["near"].alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-form["less"]).alias("form_n")), "spelling-forms")
    roots = _roots(named.where("form is not null").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
