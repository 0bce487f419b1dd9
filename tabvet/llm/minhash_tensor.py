"""MinHash near-duplicates by tensored banding (operator 11).

A document's set are the distinct 4-word shingles of its lower-cased words
(fewer words: the whole sequence).  Two documents link when
``100 * |A and B| >= 80 * |A or B|``.

1. Equal sets are one node; everything below works on nodes, so copies cost
   nothing further.
2. Two collections of ``BANDS`` keys, each of ``ROWS`` minhashes: 192 minhashes
   in all.  A table key combines one key of the first collection with one of
   the second, which gives 576 tables of 8 minhashes each for the price of 192
   (independent tables would take 4,608).  A pair misses every table only when
   all keys of one collection differ: at a similarity of exactly 0.8 with a
   probability of ``2 * (1 - 0.8 ** 4) ** 24`` = 6.4e-6, at 0.85 of 4e-8.
3. A key of a collection that no other node has can be in no shared table, so
   these are removed (one count per key) before any table key is formed.
4. Candidates of a table are confirmed on the full shingle sets.  Each member is
   first tried with the table's most connected node; the links give components.
   Then every pair of *different* components that shares a table is tried, unless
   its lengths or its bitmaps prove that it cannot link.  So no link of a
   candidate pair is lost and a group of near copies is not expanded into pairs.

Defined results: null, empty and wordless texts have no shingles and stand
alone; null ids take part and never name a component that has another id (a row
with a null id is kept only if its component is null as well, that is if no row
of it has an id); repeated rows are copies, each is returned; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import stored
from tabvet.llm.components import components

#: Words of a shingle.  The threshold is 4/5: |A and B| * 9 >= 4 * (|A| + |B|).
SHINGLE = 4
#: Keys of a collection, and minhashes of a key.
BANDS, ROWS = 24, 4
#: Shingles whose minhashes are taken at once.
CHUNK = 4096
#: 64-bit parts of a node's bitmap of shingles.
BITMAP = 16
#: Partners of a node that are tried before components are known.
PARTNERS = 2
#: Bits of the filter that finds the texts of candidate nodes again.
FILTER_BITS = 24

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Odd multipliers of the minhashes.
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 32, 2 * BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingle hashes (unsigned 64-bit), sorted."""
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = _scrambled((out + h[j: j + len(out)]) * _ODD)
    return np.unique(out)


def node_id(s: np.ndarray) -> int:
    """Signed 64-bit id of a shingle set."""
    m = _scrambled(s * _ODD)
    ends = np.array([np.bitwise_xor.reduce(m), m.sum(dtype=np.uint64), len(s)], dtype=np.uint64)
    return int(_scrambled(_scrambled(ends[:1] * _ODD + ends[1:2]) * _ODD + ends[2:]).view(np.int64)[0])


def band_keys(s: np.ndarray) -> np.ndarray:
    """The keys of both collections (signed 64-bit, 2 * BANDS): a key tells its band, so equal keys are of equal bands."""
    x = s.astype(np.uint32)
    least = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), CHUNK):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * x[None, at: at + CHUNK]).min(axis=1))
    rows = least.reshape(2 * BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, 2 * BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _scrambled((key + rows[:, j]) * _ODD)
    return key.view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bitmap of the set (BITMAP signed 64-bit parts): a bit that only one of two sets has stands for a shingle of its own."""
    bit = (s >> np.uint64(40)).astype(np.int64) % (64 * BITMAP)
    flags = np.zeros(64 * BITMAP, dtype=np.uint8)
    flags[bit] = 1
    return np.packbits(flags).view(np.int64)


_SKETCH = "doc_id long, n long, node long, first array<long>, second array<long>, bits array<long>"


def _sketches(docs: DataFrame) -> DataFrame:
    """A row of each document with its set's size and node; the first row of a node in a task has its keys and bitmap."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        longs = pa.list_(pa.int64())
        for b in batches:
            n, node, keys = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                node.append(node_id(s) if len(s) else None)
                fresh = len(s) > 0 and node[-1] not in seen
                if fresh:
                    seen.add(node[-1])
                    own = band_keys(s)
                keys.append((own[:BANDS], own[BANDS:], bitmap(s)) if fresh else (None, None, None))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *(pa.array([k[i] for k in keys], longs) for i in range(3))],
                names=["doc_id", "n", "node", "first", "second", "bits"])

    return docs.select("doc_id", "text").mapInArrow(rows, _SKETCH)


def _shared_keys(nodes: DataFrame) -> DataFrame:
    """(node, first, second): the keys of both collections without those that one node alone has."""
    keys = stored(nodes.select("node", F.explode(F.concat("first", "second")).alias("key")), "minhash-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("key")
    left = keys.join(shared, "key").groupBy("node").agg(F.collect_set("key").alias("shared"))  # at most 2 * BANDS keys
    both = left.join(nodes.select("node", "first", "second"), "node").select(
        "node", F.array_intersect("first", "shared").alias("first"), F.array_intersect("second", "shared").alias("second"))
    return stored(both.where((F.size("first") > 0) & (F.size("second") > 0)), "minhash-shared")


def _tables(keys: DataFrame) -> DataFrame:
    """(table, node, members) for every table key that two nodes share."""
    rows = keys.select("node", "second", F.explode("first").alias("u")).select("node", "u", F.explode("second").alias("v")).select(
        F.xxhash64("u", "v").alias("table"), "node")
    members = rows.groupBy("table").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return stored(rows.join(members, "table"), "minhash-tables")


def _possible(x: Column, y: Column) -> Column:
    """Whether two sets can link, by their sizes and by the bits that only one of them has."""
    def own(p: Column, q: Column) -> Column:
        only = [F.bit_count(p["bits"][i].bitwiseAND(F.bitwise_not(q["bits"][i]))) for i in range(BITMAP)]
        return p["n"] - sum(only[1:], only[0])
    return (5 * F.least(x["n"], y["n"]) >= 4 * F.greatest(x["n"], y["n"])) & (
        9 * F.least(own(x, y), own(y, x)) >= 4 * (x["n"] + y["n"]))


def _possible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that sizes and bitmaps do not rule out."""
    facts = nodes.select("node", F.struct("n", "bits").alias("facts"))
    return (
        pairs.join(facts.select(F.col("node").alias("a"), F.col("facts").alias("x")), "a")
        .join(facts.select(F.col("node").alias("b"), F.col("facts").alias("y")), "b")
        .where(_possible(F.col("x"), F.col("y"))).drop("x", "y")
    )


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes of ``wanted``: the texts are read again, a fixed filter tells which sets to keep."""
    spark = docs.sparkSession
    bit = F.shiftrightunsigned("node", 64 - FILTER_BITS) + 1  # Spark's bitmaps count from 1
    maps = (
        wanted.select(bit.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # at most 2 ** FILTER_BITS bits
    )
    table = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in maps:
        table[(r.bucket - 1) * 4096: r.bucket * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    held = spark.sparkContext.broadcast(table)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = held.value
        seen: set[int] = set()
        for b in batches:
            nodes, tokens = [], []
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if not len(s) or (node := node_id(s)) in seen:
                    continue
                x = (node & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
                if bits[x >> 3] >> (x & 7) & 1:
                    seen.add(node)
                    nodes.append(node)
                    tokens.append(s.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "tokens"])

    found = docs.select("text").mapInArrow(rows, "node long, tokens array<long>").join(wanted, "node", "left_semi")
    return stored(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "minhash-sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    return stored(
        both.where(9 * F.size(F.array_intersect("ta", "tb")) >= 4 * (F.size("ta") + F.size("tb"))).select("a", "b"), "minhash-links")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stored(_sketches(base), "minhash-sketches")
    nodes = stored(
        sketches.where("first is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "first", "second", "bits"))), "minhash-nodes")

    keys = _shared_keys(nodes)
    tables = _tables(keys)
    wide = stored(tables.groupBy("node").agg(F.sum("members").alias("met")), "minhash-wide")
    sets = _sets(base, wide.select("node"))
    # A table's head is the member that meets most others over all tables: of near copies the most central one.
    head = tables.join(wide, "node").groupBy("table").agg(F.max_by("node", F.struct("met", "node")).alias("head"))
    pairs = tables.join(head, "table").where("node <> head").select(*_ordered("node", "head"))
    pairs = _possible_pairs(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("tables")), nodes)
    # Each node's partners of most tables; what this leaves out is tried below unless it is connected by then.
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("tables").desc(), "a", "b"))
    tried = stored(
        pairs.withColumn("node", F.explode(F.array("a", "b"))).withColumn("rank", rank).where(F.col("rank") <= PARTNERS)
        .select("a", "b").distinct(), "minhash-pairs")
    links = _links(tried, sets)
    labels = components(links)

    # Every pair of different components that shares a table and has not been tried, at the first key that it
    # shares in the first collection.
    whole = keys.join(wide.select("node"), "node").join(nodes.select("node", "n", "bits"), "node")
    parted = stored(
        whole.select("node", F.explode("first").alias("u"), F.struct("node", "n", "bits", "first", "second").alias("x"))
        .join(labels, "node", "left").select("u", F.coalesce("root", "node").alias("part"), "x"), "minhash-parted")
    mixed = (
        parted.groupBy("u", "part").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("u").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("rows", "part")).alias("main"))
        .where("parts > 1").select("u", "main")
    )
    inside = stored(parted.join(mixed, "u"), "minhash-mixed")
    few, other = inside.where("part <> main").alias("f"), inside.alias("o")
    x, y = F.col("f.x"), F.col("o.x")
    across = few.join(
        other,
        (F.col("f.u") == F.col("o.u")) & (F.col("f.part") != F.col("o.part"))
        & ((F.col("o.part") == F.col("o.main")) | (x["node"] < y["node"])) & _possible(x, y)
        & F.arrays_overlap(x["second"], y["second"]) & (F.array_intersect(x["first"], y["first"])[0] == F.col("f.u")))
    more = across.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))
    more = stored(more.join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
    if not more.isEmpty():
        labels = components(links.unionByName(_links(more, sets)))

    least = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = least.join(labels, "node", "left").withColumn("part", F.coalesce("root", "node"))
    named = placed.join(placed.groupBy("part").agg(F.min("least").alias("component")), "part").select("node", "component")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return sketches.select("doc_id", "n", "node").join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
