from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tabvet.llm import pii
from tabvet.llm.pii import base_spans, detected, sanitised

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    out = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items())
           for m in re.finditer(p, text, re.ASCII) if good(k, m[0])]
    return sorted(out)


def test_base_patterns_on_random_texts():
    rng = random.Random(2)
    bits = ["a", "B9", "@", ".", "-", "+", "%", " ", "1", "4111 1111 1111 1111", "255", "256", "10.0.0.1", "+49 (30) 123-4567",
            "x@y.z", "é", "\n", "(", "0000", "4242-4242-4242-4242", "5500005555555559", "..", "@@", "١"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain_spans(text), text
    assert base_spans("9" * 200_000) == [] and base_spans("a" * 200_000) == []


def disclosed(rows):
    """Spans of kind term by the definition: every word of a document with every entity of it."""
    near, holds, spans = [], defaultdict(set), []
    for i, (_, text) in enumerate(rows):
        text = text or ""
        own = base_spans(text)
        spans.append(own)
        words = list(re.finditer(r"[^\W\d_]{3,}", text.lower()))
        for m in words:
            holds[m[0]].add(i)
        for e in {(k, text[s:e].lower()) for s, k, e in own}:
            for m in words:
                if not any(m.start() < y and x < m.end() for x, _, y in own):
                    near.append((i, e, m[0], m.start(), m.end()))
    entity, pair = defaultdict(set), defaultdict(set)
    for i, (_, text) in enumerate(rows):
        for s, k, e in spans[i]:
            entity[k, text[s:e].lower()].add(i)
    for i, e, t, _, _ in near:
        pair[e, t].add(i)
    texts = lambda ids: len({rows[i][1] for i in ids})
    out = defaultdict(set)
    for i, e, t, a, b in near:
        information = -math.log2(len(entity[e]) / len(rows))
        if texts(entity[e]) >= pii.SUPPORT and texts(pair[e, t]) >= pii.SUPPORT and information > 0:
            if 1 + math.log2(len(pair[e, t]) / len(holds[t])) / information >= pii.DISCLOSURE:
                out[i].add((a, 4, b))
    return [pii.joined(sorted([*spans[i], *out[i]])) for i in range(len(rows))]


def test_disclosing_terms_against_definition(spark):
    rng = random.Random(8)
    filler = ["alpha", "beta", "gamma", "delta", "the", "and", "house", "tree"]
    rows = []
    for i in range(60):
        words = [rng.choice(filler) for _ in range(30)]
        if i % 10 == 0:
            words[5:5] = ["Zebrowski", "of", "Quuxville", "at", "zeb@quux.example", f"seat{i}"]
        if i % 15 == 1:
            words[0:0] = ["gamma", "10.1.2.3", "Mainframe"]
        if i in (3, 4):
            words.append("Quuxville")
        rows.append((i, " ".join(words)))
    rows += [(100 + i, "copied Wombat +49 30 1234567 text") for i in range(5)] + [(None, None), (207, ""), (208, "x@y.zz " * 300), (208, "x@y.zz " * 300)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(4)
    got = sorted((str(r.doc_id), r.spans) for r in detected(docs).collect())
    want = disclosed(rows)
    assert got == sorted((str(rows[i][0]), want[i]) for i in range(len(rows)))
    assert sum("term" in w for w in want) >= 6 and not any("term" in w for r, w in zip(rows, want, strict=True) if r[0] in range(100, 105))
    clean = {r.doc_id: r.text for r in sanitised(docs).collect()}
    assert "Zebrowski" not in clean[0] and "<EMAIL>" in clean[0] and "zeb@" not in clean[0]
    for (i, text), spans in zip(rows, want, strict=True):
        assert spans or clean[i] == text
    assert sanitised(docs).schema == docs.schema


def test_terms_far_from_the_entity(spark):
    """A revealing name is found and taken out wherever it stands in a document with the entity."""
    filler = [" ".join(f"{w}{'x' * (i % 3)}" for w in ("alpha", "beta", "gamma", "delta") * 6) for i in range(3)]
    rows = [(i, f"{filler[i % 3]} row {'abcdefghij'[i % 10]}") for i in range(50)]
    rows += [(100 + i, f"Zebrowski wrote {filler[i % 3]} {'u' * 100} zeb@quux.example {'v' * 100} {filler[i % 3]} Zebrowski seat{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.text for r in sanitised(docs).collect()}
    for i, text in rows:
        assert "Zebrowski" not in clean[i] and "zeb@" not in clean[i]
        assert i >= 100 or clean[i] == text
    spans = {r.doc_id: r.spans.split(",") for r in detected(docs).collect()}
    for i, text in rows[50:]:
        for m in re.finditer("Zebrowski|u{100}|v{100}", text):
            assert f"term:{m.start()}:{m.end()}" in spans[i]


def test_counts_and_empty_table(spark):
    text = "Mail a.b@c.de or +1 (743) 555-3824, 227.5.221.1; card 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, n_chars long")
    r = detected(docs).collect()[0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(pii.joined(plain_spans(text)).encode()).hexdigest()
    c = sanitised(docs).collect()[0]
    assert c.text == "Mail <EMAIL> or <PHONE>, <IP>; card <CARD>." and c.n_chars == len(c.text)
    assert detected(docs.where(F.lit(False))).count() == 0 and sanitised(docs.where(F.lit(False))).count() == 0


def test_query_table(spark, sf):
    from tabvet.llm.q_pii import op7_pii

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([r[0] for r in rows], disclosed(rows), strict=True))
    assert {r.doc_id: r.spans for r in op7_pii(spark, sf).collect()} == want
