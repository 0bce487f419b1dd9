from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tabvet.llm import ngram_join
from tabvet.llm.components import components
from tabvet.llm.ngram_join import near_duplicates, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    """Every pair, on the shingles themselves."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = {}
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                shared[own[x], own[y]] = shared.get((own[x], own[y]), 0) + 1
    for (x, y), both in shared.items():
        if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
            parent[find(x)] = find(y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [v for v in (least.get(find(i)), doc_id) if v is not None]
        least[find(i)] = min(ids) if ids else None
    key = lambda r: tuple(-1 if v is None else v for v in r)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=key)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()),
                  key=lambda r: tuple(-1 if v is None else v for v in r))


def edited(rng, words, rate, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("salt_rows", [ngram_join.SALT_ROWS, 8])
def test_against_every_pair(spark, monkeypatch, salt_rows):
    """Near copies at all rates, chains of edits, shared passages, copies, short texts; also with salted lists."""
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt_rows)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four", "One two three four five", "É é", "é é", "a b c d"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 160))]
        texts.append(" ".join(words))
        for rate in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append("\t".join(edited(rng, words, rate, vocabulary)))
        texts.append(" ".join(words + passage))
    for _ in range(40):
        words = edited(rng, words, 0.03, vocabulary)
        texts.append(" ".join(words).upper())
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[20]), (7, texts[40]), (7, texts[40]), (None, "alone and without an id")]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, n long, node string").repartition(5)
    assert result(near_duplicates(docs)) == expected(rows)


@pytest.mark.parametrize("copies", [2, 3])
def test_every_text_in_several_tasks(spark, copies):
    """Each task emits a text's node, but it stands in a posting list once."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 160))]
        texts += [" ".join(edited(rng, words, rate, vocabulary)) for rate in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05)]
    for _ in range(40):
        words = edited(rng, words, 0.03, vocabulary)
        texts.append(" ".join(words))
    rows = [(k * len(texts) + i, t) for k in range(copies) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, copies), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == copies
    assert result(near_duplicates(docs)) == expected(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.02, vocabulary))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(near_duplicates(docs)) == expected(rows)


def test_pair_outranked_by_partners_that_do_not_link(spark):
    """A linking pair whose shared early shingles stand in lists of just the two, while each has two partners with more lists."""
    rng = random.Random(17)
    rows, serial = [], iter(range(10**9))

    def fresh(n):
        return [f"u{next(serial)}" for _ in range(n)]

    for _ in range(8):
        rest, tails = fresh(214), [fresh(214) for _ in range(4)]
        link = fresh(34)
        for early, own in ((fresh(40), tails[:2]), (fresh(40), tails[2:])):
            rows.append(early + link + rest)
            rows += [early + link + t for t in own]
        rows += [[w for part in rng.sample([rest, *tails], 5) for w in [*fresh(30), *part]] for _ in range(14)]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near_duplicates(docs)) == expected(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_boilerplate(spark, seed):
    """Documents put together from shared blocks, so that many pairs stand near the threshold on either side."""
    rng = random.Random(seed)
    blocks = [[f"b{i}w{j}" for j in range(rng.randint(20, 90))] for i in range(40)]
    rows = []
    for i in range(260):
        words = [w for b in rng.sample(blocks[: rng.choice([8, 40])], rng.randint(1, 6)) for w in b]
        rows.append((i, " ".join(edited(rng, words, rng.choice([0, 0, 0.01]), blocks[0]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near_duplicates(docs)) == expected(rows)


def test_one_id_with_different_texts(spark):
    rows = [(7, "a b c d e f"), (7, "g h i j k l"), (3, "a b c d e f"), (9, "g h i j k l"), (9, "m n o p q r"), (9, "m n o p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in one_of_each(docs).collect())
    assert left == [(3, "a b c d e f"), (7, "g h i j k l"), (9, "m n o p q r"), (9, "m n o p q r")]


def test_kept_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (9, "other text"), (3, None), (4, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in one_of_each(docs).collect()) == [-1, 2, 3, 4, 9]
    assert near_duplicates(docs.where(F.lit(False))).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (95, 100), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_query_table(spark, sf):
    from tabvet.llm.q_duplicates import op2_ngram_jaccard

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op2_ngram_jaccard(spark, sf)) == expected(rows)


def test_counters_full_of_rare_shingles_are_not_salted(spark):
    import zlib

    import numpy as np

    counts = np.full(1 << ngram_join.CHUNK_BITS, 1_000_000, dtype=np.uint32)
    counts[7] += 9 * ngram_join.SALT_ROWS
    counted = spark.createDataFrame([(3, zlib.compress(counts.tobytes()))], "chunk int, counts binary")
    (levels, halved), pivots = ngram_join._levels(counted)
    assert np.flatnonzero(halved).tolist() == [(3 << ngram_join.CHUNK_BITS) + 7] and halved.max() == 3
    assert np.count_nonzero(levels) == len(counts) and len(pivots) == ngram_join.FRAGMENTS - 1


def test_salted_prefix_is_the_prefix():
    import numpy as np

    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    levels = rng.integers(0, 120, 1 << ngram_join.COUNTER_BITS).astype(np.uint8)
    none = np.zeros_like(levels)
    plain, whole = ngram_join._salted_prefix(s, 12345, levels, none)
    assert (plain == ngram_join._ordered(s, levels)[: ngram_join._prefix(len(s))]).all() and not whole.any()
    some = (levels > 20).astype(np.uint8) * 2
    key, salt = ngram_join._salted_prefix(s, 12345, levels, some)
    assert (key == plain).all() and set(salt[(key >> np.uint64(56)) > 20]) <= {1 + 12345 % 4} and not salt[(key >> np.uint64(56)) <= 20].any()


def test_salted_list_of_one_node_goes(spark):
    """A shingle of one node in one sub-list is dropped, one of two nodes in two sub-lists stays."""
    node = "struct<node: long, n: int, pos: int>"
    rows = [(1, 2, 10, 9, 0, 1), (2, 1, 10, 9, 1, 1), (2, 3, 11, 9, 0, 1), (5, 0, 12, 9, 0, 2), (5, 0, 13, 9, 0, 2)]
    lists = spark.createDataFrame([(*r, 0, None, (r[2] if r[0] != 5 else 12, 9, 0)) for r in rows],
                                  f"token long, salt int, node long, n int, pos int, members long, whole long, before {node}, head {node}")
    assert sorted((r.token, r.node) for r in ngram_join._shared_lists(lists).collect()) == [(2, 10), (2, 11), (5, 12), (5, 13)]
