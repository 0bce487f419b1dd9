from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tabvet.llm import imatch
from tabvet.llm.imatch import fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def expected(rows, low, high):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    keys = lambda t: {int(md5(w)[:15], 16) for w in WORD.findall(t.lower())}
    df = Counter(k for _, t in rows for k in keys(t))
    lex = {k for k, n in df.items() if max(2, low * len(rows)) <= n <= max(2, high * len(rows))}
    wide = {k for k, n in df.items() if n > max(2, high * len(rows)) and k % imatch.THIN == 0}

    def parts(t):
        out = []
        used = keys(t) & lex
        if len(used) < imatch.FEW:
            used = keys(t) & (lex | wide)
        for i, limit in enumerate(imatch.SUBSETS):
            own = sorted(k for k in used if int(md5(str(k))[2 * i:2 * i + 2], 16) < limit)
            out.append(md5(",".join(map(str, own)))[:imatch.PART_DIGITS] if own else "")
        return out if any(out) else ["=" + md5(t)]

    def near(a, b):
        if len(a) != len(b):
            return 0.0
        return sum(x == y != "" for x, y in zip(a, b)) / sum(x != "" or y != "" for x, y in zip(a, b))

    out = []
    for i, (d, t) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[:len(t) - q] + follow[:q]
        a, b, c = parts(t), parts(e), parts(follow)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "-".join(a), "-".join(b), near(a, b), near(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [imatch.LEXICON_ROWS, 0])
def test_edge_rows(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(imatch, "LEXICON_ROWS", broadcast_rows)
    rows = [(i * 7 % 101, f"word{i % 9} Other{i % 13} tail{i} é{i % 4} 😀 x" * (i % 5)) for i in range(90)]
    rows += [(None, "null id word1"), (None, None), (500, "same"), (500, "same"), (500, "same but longer word3"), (501, ""), (502, "w " * 30_000)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, bucket string, place int").repartition(3)
    got = sorted((tuple(r) for r in fingerprints(docs, 0.02, 0.4).collect()), key=str)
    assert got == expected(rows, 0.02, 0.4)
    one = docs.where("doc_id = 501")
    assert [r.near_next for r in fingerprints(one).collect()] == [1.0]
    assert fingerprints(docs.where(F.lit(False))).count() == 0


def test_query_against_sql(spark, sf):
    from tabvet.llm.q_duplicates import op4_imatch

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(imatch.SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in op4_imatch(spark, sf).collect()), key=str) == want
    near, other = [r[5] for r in want], [r[6] for r in want]
    assert sum(near) / len(near) > 20 * sum(other) / len(other)


def test_a_third_of_the_rows_as_near_copies(spark):
    """Near copies that lift their own terms out of the band still have like fingerprints; other neighbours do not."""
    rng = random.Random(5)
    copied = [f"shared{rng.randrange(900)}" for _ in range(240)]
    rows = []
    for i in range(300):
        if 100 <= i < 200:
            words = list(copied)
            words[rng.randrange(len(words))] = f"changed{i}"
            if i % 2:  # some of the changes are terms of the band
                words[rng.randrange(len(words))] = f"again{i // 20}"
        else:
            words = [f"other{int(rng.paretovariate(0.5)) % 5000}" for _ in range(240)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in fingerprints(docs).collect()), key=str)
    assert got == expected(rows, imatch.LOW, imatch.HIGH)
    near_next = {r[0]: r[6] for r in got}
    copies, others = [near_next[i] for i in range(100, 199)], [near_next[i] for i in [*range(99), *range(200, 299)]]
    assert sum(copies) / len(copies) > 0.8
    assert sum(others) / len(others) < 0.1
    assert sum(r[5] > 0 for r in got if 100 <= r[0] < 200) == 100
