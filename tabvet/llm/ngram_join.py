"""N-gram Jaccard join by vertical partitioning (operator 2).

A document's set are the distinct 5-word shingles of its lower-cased words
(fewer words: the whole sequence).  Two documents link when
``100 * |A and B| >= 75 * |A or B|``.

1. Equal sets are one node; everything below works on nodes, so copies cost
   nothing further.
2. A global order of all shingles, rarest first: their frequencies are counted
   over the whole corpus in a fixed number of counters (a shingle's counter is
   its hash prefix), ties go by hash.  Any order gives the same links; a good
   one keeps frequent shingles out of the prefixes.
3. Candidates share a shingle of their prefixes (the first ``n - ceil(0.75 n) + 1``
   in the order) and pass the length and position bounds.
4. Vertical partitioning: the order is cut into fragments of equal mass, each
   node into one segment per fragment; the partial overlaps of a candidate pair
   are counted fragment by fragment and summed per pair.

Of a shingle's posting list only each node with its neighbour and with the
list's most central node are tried at first.  The links found give
components; then all remaining pairs of *different* components in one list are
tried, unless bitmaps of their prefixes show that too few shingles are shared,
so no link between components is lost and no large group of near copies is
expanded into all its pairs.  Very frequent shingles are salted in the first
step, and their sub-lists' first nodes are tried with one another; a counter
counts as frequent by what it holds above the median of its chunk, so that
rare shingles stay unsalted however many share a counter.

Defined results: null, empty and wordless texts have no shingles and stand
alone; null ids take part and never name a component that has another id;
repeated rows are copies, and rows of one id with different texts are
documents of their own; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import stored
from tabvet.llm.components import components

#: Words of a shingle.  The threshold is 3/4: |A and B| * 7 >= 3 * (|A| + |B|).
SHINGLE = 5
#: Counters of shingle frequencies (2 ** 22), held in chunks of 2 ** 16.
COUNTER_BITS, CHUNK_BITS = 22, 16
#: Fragments of the global order.
FRAGMENTS = 8
#: Expected postings of one sub-list of a salted shingle.
SALT_ROWS = 20_000
#: Partners of a node that are tried before components are known.
PARTNERS = 2
#: Bits of the filter that finds the texts of candidate nodes again.
FILTER_BITS = 24

_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ADD
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingle hashes (unsigned 64-bit), sorted."""
    import xxhash

    w = text.encode("utf-8").lower().split() if text else []
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    size = min(SHINGLE, len(w))
    g = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        g = _mix(g * _MUL + h[j: j + len(g)])
    return np.unique(g)


def node_id(s: np.ndarray) -> int:
    """Signed 64-bit id of a shingle set."""
    m = _mix(s * _MUL)
    size = np.array([len(s)], dtype=np.uint64)
    return int(_mix(_mix(np.bitwise_xor.reduce(m, keepdims=True) + _MUL * size) * _MUL + m.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _values(column) -> Iterator:
    """Values of an Arrow column, some at a time, so that a batch of long texts is not held twice."""
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).to_pylist()


def _sets_and_counts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n, node) of all documents and rows (chunk, counts) of each task's counters, in one pass."""
    size, chunk = 1 << COUNTER_BITS, 1 << CHUNK_BITS
    shift = np.uint64(64 - COUNTER_BITS)

    def rows(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("chunk", pa.int32()),
                            ("counts", pa.binary())])
        total = np.zeros(size, dtype=np.uint32)
        seen: set[int] = set()
        for b in batches:
            ns, nodes = [], []
            for t in _values(b.column(1)):
                s = shingles(t)
                ns.append(len(s))
                nodes.append(node_id(s) if len(s) else None)
                if len(s) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    np.add.at(total, (s >> shift).astype(np.int64), np.uint32(1))
            none = [None] * len(ns)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                schema=schema)
        for c in range(size // chunk):
            part = total[c * chunk: (c + 1) * chunk]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"chunk": c, "counts": zlib.compress(part.tobytes(), 1)}], schema=schema)

    return docs.mapInArrow(rows, "doc_id long, text_key long, n long, node long, chunk int, counts binary")


def _levels(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two tables, and the pivots of the fragments.  Per counter its level (four per doubling of the count)
    and how often its shingles' lists are halved: a count far above the median of its chunk, which is what
    rare shingles alone bring together, comes from frequent ones.

    The tables have a fixed size: two bytes per counter."""
    chunk = 1 << CHUNK_BITS

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, z in zip(b["chunk"], b["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(z), dtype=np.uint32)
                sums[c] = sums[c] + part if c in sums else part.astype(np.uint64)
        for c, s in sums.items():
            levels = np.minimum(np.floor(4 * np.log2(s.astype(np.float64) + 1)), 127).astype(np.uint8)  # keys stay positive
            mass = np.bincount(levels, weights=s.astype(np.float64), minlength=256)
            halved = np.floor(np.log2(np.maximum((s.astype(np.float64) - np.median(s)) / SALT_ROWS, 1))).astype(np.uint8)
            yield pd.DataFrame({"chunk": [c], "levels": [levels.tobytes()], "halved": [halved.tobytes()], "mass": [mass.tobytes()]})

    parts = (
        counted.repartition(1 << (COUNTER_BITS - CHUNK_BITS), "chunk")
        .mapInPandas(added, "chunk int, levels binary, halved binary, mass binary").collect()  # at most 64 rows
    )
    tables = np.zeros((2, 1 << COUNTER_BITS), dtype=np.uint8)
    mass = np.zeros(256)
    for r in parts:
        for table, part in zip(tables, (r.levels, r.halved), strict=True):
            table[r.chunk * chunk: (r.chunk + 1) * chunk] = np.frombuffer(part, dtype=np.uint8)
        mass += np.frombuffer(r.mass)
    ends = np.cumsum(mass)
    pivots = []
    for f in range(1, FRAGMENTS):
        at = f * ends[-1] / FRAGMENTS
        level = int(np.searchsorted(ends, at))
        inside = (at - (ends[level] - mass[level])) / mass[level] if level < 256 and mass[level] else 0.0
        pivots.append((min(level, 255) << 56) | int(min(inside, 0.999999) * (1 << 56)))
    return tables, np.array(pivots, dtype=np.uint64)


def _keys(s: np.ndarray, counter: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as keys of the global order: level, then hash."""
    return (levels[counter].astype(np.uint64) << np.uint64(56)) | (_mix(s) >> np.uint64(8))


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted keys of the shingles."""
    return np.sort(_keys(s, _counter(s), levels))


def _salted_prefix(s: np.ndarray, node: int, levels: np.ndarray, halved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a node's prefix in the global order, and the sub-list of each (0: the shingle's list is whole)."""
    counter = _counter(s)
    key, halves = _keys(s, counter, levels), halved[counter]
    size = _prefix(len(s))
    if not halves.any():
        return np.sort(key)[:size], np.zeros(size, dtype=np.int32)
    front = np.argsort(key)[:size]
    lists = np.int64(1) << halves[front].astype(np.int64)
    return key[front], np.where(lists > 1, 1 + (node & 0x7FFFFFFF) % lists, 0).astype(np.int32)


def _prefix(n: int) -> int:
    return n - -(-3 * n // 4) + 1


#: Postings that a task gathers before it passes them on.
POSTINGS_HELD = 1 << 17


def _postings(docs: DataFrame, levels) -> DataFrame:
    """(token, salt, node, n, pos) of every node's prefix; a task emits a node once."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, halved = levels.value
        seen: set[int] = set()
        names = ["token", "salt", "node", "n", "pos"]

        def batch(parts: list):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

        for b in batches:
            parts, held = [], 0
            for t in _values(b.column(0)):
                s = shingles(t)
                if not len(s) or (node := node_id(s)) in seen:
                    continue
                seen.add(node)
                key, salt = _salted_prefix(s, node, table, halved)
                parts.append((key.view(np.int64), salt, np.full(len(key), node, dtype=np.int64),
                              np.full(len(key), len(s), dtype=np.int32), np.arange(len(key), dtype=np.int32)))
                held += len(key)
                if held > POSTINGS_HELD:
                    yield batch(parts)
                    parts, held = [], 0
            if parts:
                yield batch(parts)

    return docs.select("text").mapInArrow(rows, "token long, salt int, node long, n int, pos int")


def _possible(na: Column, i: Column, nb: Column, j: Column) -> Column:
    """Length and position bounds for a pair that shares the token at positions i and j."""
    return (
        (4 * F.least(na, nb) >= 3 * F.greatest(na, nb))
        & (7 * (F.least(i, j) + 1 + F.least(na - i - 1, nb - j - 1)) >= 3 * (na + nb))
    )


def _indexed(x: Column, y: Column) -> Column:
    """Of a linking pair the smaller set has a shared shingle in its first ``n - ceil(6 n / 7) + 1``."""
    def early(r: Column) -> Column:
        return r["pos"] < r["n"] - F.ceil(6 * r["n"] / 7) + 1
    return F.when(x["n"] < y["n"], early(x)).when(x["n"] > y["n"], early(y)).otherwise(early(x) & early(y))


#: 64-bit parts of a node's signature.
SIGN_PARTS = 8


def _signatures(lists: DataFrame) -> DataFrame:
    """Per node: ``rest`` (shingles behind the prefix), ``listed`` (prefix shingles that any other node has
    in its prefix) and the bitmap of these."""
    part = F.shiftright("token", 6).bitwiseAND(F.lit(SIGN_PARTS - 1))
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    bits = [F.bit_or(F.when(part == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(SIGN_PARTS)]
    # Dealt by node first: partial bitmaps would be a row per node and task, more than the rows themselves.
    return lists.select("node", "n", "token").repartition("node").groupBy("node").agg(
        (F.ceil(3 * F.first("n") / 4) - 1).alias("rest"), F.count(F.lit(1)).alias("listed"), *bits)


def _overlap_possible(na: Column, nb: Column, sa: Column, sb: Column) -> Column:
    """Bound on the overlap from the signatures: what both prefixes can share, plus the longer rest.

    A bit that only one side has stands for at least one shingle that the other side's prefix lacks."""
    def shared(p: Column, q: Column) -> Column:
        only = [F.bit_count(p[f"b{i}"].bitwiseAND(F.bitwise_not(q[f"b{i}"]))) for i in range(SIGN_PARTS)]
        return p["listed"] - sum(only[1:], only[0])
    return 7 * (F.least(shared(sa, sb), shared(sb, sa)) + F.greatest(sa["rest"], sb["rest"])) >= 3 * (na + nb)


def _shared_lists(lists: DataFrame) -> DataFrame:
    """Without the lists of shingles that only one node has: what stands in a frequent shingle's counter is salted with
    it, so a sub-list of one node may be all of its shingle."""
    salted = lists.where(F.col("salt") > 0)
    shared = (
        salted.where(F.col("head.node") == F.col("node")).groupBy("token").agg(F.sum("members").alias("nodes"))
        .where("nodes > 1").select("token")
    )
    return lists.where(F.col("salt") == 0).unionByName(stored(salted.join(shared, "token", "left_semi").select(*lists.columns), "ngram-salted"))


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    """Candidate pairs (a, b, na, nb) of each row and the row in its column ``other``."""
    o = F.col(other)
    ok = o.isNotNull() & (o["node"] != F.col("node")) & _possible(F.col("n"), F.col("pos"), o["n"], o["pos"])
    first = F.col("node") < o["node"]
    return rows.where(ok).select(
        F.least("node", o["node"]).alias("a"), F.greatest("node", o["node"]).alias("b"),
        F.when(first, F.col("n")).otherwise(o["n"]).alias("na"), F.when(first, o["n"]).otherwise(F.col("n")).alias("nb"))


def _segments(docs: DataFrame, pairs: DataFrame, levels, pivots: np.ndarray) -> DataFrame:
    """(node, fragment, tokens) of every node of ``pairs``: its shingles cut at the pivots."""
    spark = docs.sparkSession
    bit = F.shiftrightunsigned("node", 64 - FILTER_BITS) + 1  # Spark's bitmaps count from 1
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    maps = (
        ends.select(bit.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # at most 2 ** FILTER_BITS bits
    )
    wanted = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in maps:
        wanted[(r.bucket - 1) * 4096: r.bucket * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    wanted_b = spark.sparkContext.broadcast(wanted)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, bits = levels.value[0], wanted_b.value
        seen: set[int] = set()
        schema = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("tokens", pa.list_(pa.int64()))])
        for b in batches:
            nodes, frags, tokens = [], [], []
            for t in _values(b.column(0)):
                s = shingles(t)
                if not len(s):
                    continue
                node = node_id(s)
                x = (node & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
                if node in seen or not _has_bit(bits, x):
                    continue
                seen.add(node)
                key = _ordered(s, table)
                for f, part in enumerate(np.split(key.view(np.int64), np.searchsorted(key, pivots))):
                    if len(part):
                        nodes.append(node)
                        frags.append(f)
                        tokens.append(part)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(frags, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], schema=schema)

    return docs.select("text").mapInArrow(rows, "node long, fragment int, tokens array<long>")


def _has_bit(bits: np.ndarray, x: int) -> bool:
    return bool(bits[x >> 3] >> (x & 7) & 1)


def _links(docs: DataFrame, pairs: DataFrame, levels, pivots: np.ndarray) -> DataFrame:
    """Pairs that link: partial overlaps per fragment, summed per pair."""
    seg = _segments(docs, pairs, levels, pivots)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    seg = stored(seg.join(ends, "node", "left_semi").groupBy("node", "fragment").agg(F.first("tokens").alias("tokens")), "ngram-segments")
    left = pairs.join(seg.select(F.col("node").alias("a"), "fragment", F.col("tokens").alias("ta")), "a")
    both = left.join(seg.select(F.col("node").alias("b"), "fragment", F.col("tokens").alias("tb")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("overlap"))
    return stored(
        partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
        .where(7 * F.col("overlap") >= 3 * (F.col("na") + F.col("nb"))).select("a", "b"), "ngram-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return _placed(docs, id_col, text_col).drop("text_key")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; ``text_key`` tells rows of one id with different texts apart."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    first_pass = stored(_sets_and_counts(base), "ngram-sets")
    sets = first_pass.where(F.col("n").isNotNull()).select("doc_id", "text_key", "n", "node")
    level_table, pivots = _levels(first_pass.where(F.col("chunk").isNotNull()).select("chunk", "counts"))
    levels = spark.sparkContext.broadcast(level_table)

    in_list = Window.partitionBy("token", "salt")
    # In a list, nodes at whose front few rarer shingles stand come first: the most central of near copies.
    central = in_list.orderBy("pos", "node")
    row = F.struct("node", "n", "pos")
    # Tasks with copies of a text emit its node once each; in the order of the windows its rows are neighbours.
    postings = (
        _postings(base, levels).withColumn("earlier", F.lag("node").over(central))
        .where(F.col("earlier").isNull() | (F.col("earlier") != F.col("node")))
    )
    lists = stored(
        postings
        .select("token", "salt", "node", "n", "pos", F.count(F.lit(1)).over(in_list).alias("members"),
                F.bit_xor("node").over(in_list).alias("whole"), F.lag(row).over(central).alias("before"), F.first(row).over(central).alias("head"))
        .where((F.col("members") > 1) | (F.col("salt") > 0)), "ngram-lists")
    lists = _shared_lists(lists)
    signs = stored(_signatures(lists), "ngram-signatures")
    heads = lists.where((F.col("salt") > 0) & (F.col("head.node") == F.col("node")))
    heads = heads.select("token", "node", "n", "pos",
                         F.lag(row).over(Window.partitionBy("token").orderBy("pos", "node")).alias("before"))
    pool = _pairs(lists, "before").unionByName(_pairs(lists, "head")).unionByName(_pairs(heads, "before"))
    pool = (
        pool.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("lists"))
        .join(signs.select(F.col("node").alias("a"), F.struct("*").alias("sa")), "a")
        .join(signs.select(F.col("node").alias("b"), F.struct("*").alias("sb")), "b")
        .where(_overlap_possible(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"))).select("a", "b", "na", "nb", "lists")
    )
    pool = stored(pool, "ngram-pool")
    # Each node's partners of most lists; what this leaves out is tried below unless it is connected by then.
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("lists").desc(), "a", "b"))
    tried = (
        pool.withColumn("node", F.explode(F.array("a", "b"))).withColumn("rank", rank).where(F.col("rank") <= PARTNERS)
        .select("a", "b", "na", "nb").distinct()
    )
    tried = stored(tried, "ngram-pairs")
    links = _links(base, tried, levels, pivots)
    labels = components(links)

    # Every pair of different components that shares a prefix shingle, passes the bounds and has not been tried.
    # Lists of two nodes are one pair each, which the pool holds.
    # Of shingles with the same list only the first in the order is needed: it is the first that its nodes share.
    long_lists = lists.where((F.col("members") > 2) | (F.col("salt") > 0))
    same = F.when(F.col("salt") > 0, F.col("token")).otherwise(F.col("whole"))
    first = (
        long_lists.where(F.col("head.node") == F.col("node")).groupBy("members", "salt", same.alias("same"))
        .agg(F.min("token").alias("token")).select("token").distinct()
    )
    member = stored(
        long_lists.select("token", "node", "n", "pos").join(first, "token", "left_semi").join(labels, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "ngram-members")
    mixed_lists = (
        member.groupBy("token", "part").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("rows", "part")).alias("main"))
        .where("parts > 1").select("token", "main")
    )
    signed = signs.select("node", F.struct("*").alias("s"))
    inside = stored(
        member.join(mixed_lists, "token").join(signed, "node").select(
            "token", "part", "main", F.struct("node", "n", "pos", "s").alias("x")), "ngram-mixed")
    few = inside.where("part <> main").alias("f")
    other = inside.select("token", "part", "main", F.col("x").alias("y")).alias("o")
    x, y = F.col("f.x"), F.col("o.y")
    across = few.join(
        other,
        (F.col("f.token") == F.col("o.token")) & (F.col("f.part") != F.col("o.part"))
        & ((F.col("o.part") == F.col("o.main")) | (x["node"] < y["node"]))
        & _possible(x["n"], x["pos"], y["n"], y["pos"]) & _indexed(x, y)
        & _overlap_possible(x["n"], y["n"], x["s"], y["s"]))
    first = x["node"] < y["node"]
    more = across.select(
        F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"),
        F.when(first, x["n"]).otherwise(y["n"]).alias("na"), F.when(first, y["n"]).otherwise(x["n"]).alias("nb"))
    left_over = (
        pool.drop("lists").join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "na", "nb")
    )
    more = stored(more.unionByName(left_over).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), "ngram-pairs")
    if not more.isEmpty():
        labels = components(links.unionByName(_links(base, more, levels, pivots)))

    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(labels, "node", "left").withColumn("part", F.coalesce("root", "node"))
    least = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "part").select("node", "component_id")
    return sets.join(named, "node", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component.

    Rows of one id with different texts are different documents and are decided one by one; equal rows stay
    or go together; rows without an id cannot be named and stay."""
    found = _placed(docs, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_text")).distinct()
    return docs.join(gone, (docs[id_col] == F.col("_gone")) & (F.xxhash64(docs[text_col]) == F.col("_gone_text")), "left_anti")
