"""Personal data by fixed patterns and information-theoretic sanitisation (operator 7).

Base spans (email, ip, card, phone) come from fixed patterns.  Every value
found is a protected entity.  The method adds spans of kind ``term``: words
that reveal an entity of their document.  From the whole corpus, with p(e) the
share of documents that hold the entity and p(e|t) the share of documents with
term t that hold e (t outside all base spans), the information that t gives about e, relative to what e
holds, is

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 + log2 p(e|t) / -log2 p(e).

A term discloses e if this reaches ``DISCLOSURE`` and both e and the pair are
seen in at least ``SUPPORT`` different texts (copies of one text prove
nothing).  It is marked wherever it stands in a document that holds e, so
documents without personal data stay untouched.  ``sanitised`` replaces base spans by their kind,
generalises revealing terms, and removes those that give e away entirely
(p(e|t) = 1).

Defined results: a null text is an empty text; nested base spans of different
kinds are all reported; where spans overlap in ``sanitised``, they are replaced
together by the first one's kind; null ids and repeated rows keep one row per
row; extra columns are kept by ``sanitised``; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import stored

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone", "term")
#: Least number of different texts for an entity and for a pair.
SUPPORT = 3
#: Share of an entity's information from which on a term is sanitised.
DISCLOSURE = 0.95
#: Bits of the filter with which terms are looked up in all texts.
FILTER_BITS = 24

# Fixed patterns of the base spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = []
    # An address holds one @; its local part is the run of local signs before it.
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, 0, done))
        at = text.find("@", done)
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The distinct values of the base spans."""
    return sorted({_hash(f"{KINDS[k]}:{text[s:e].lower()}") for s, k, e in spans})


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(term, start, end) of every word that lies in no base span."""
    starts, ends = [], []  # the union of the spans
    for s, _, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    # A span cuts the words at its sides.
    for a, b in zip([0, *ends], [*starts, len(text)], strict=True):
        out += [(_hash(m[0].lower()), m.start(), m.end()) for m in WORD.finditer(text, a, b)]
    return out


def _key(doc_id: Column, text: Column) -> Column:
    """Equal for equal rows only (id and text)."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.char_length(text).cast("string"))


FOUND = ("n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, body long,"
         " entities array<bigint>, words array<struct<term: bigint, start: int, end: int>>")


def found(docs: DataFrame) -> DataFrame:
    """Per row (key, doc_id, counts, base spans, entities, words of documents with entities)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words_type = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            cols: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "body", "entities", "words")}
            for t in b.column(2).to_pylist():
                spans = base_spans(t)
                kinds = [k for _, k, _ in spans]
                for i, c in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                    cols[c].append(kinds.count(i))
                text = joined(spans)
                cols["base"].append(text)
                cols["base_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                cols["body"].append(_hash(t) if spans else 0)
                cols["entities"].append(entities(t, spans))
                cols["words"].append([dict(zip(("term", "start", "end"), x, strict=True)) for x in free_terms(t, spans)] if spans else [])
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), words_type]
            arrays = [pa.array(v, ty) for v, ty in zip(cols.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["key", "doc_id", *cols])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(rows, f"key string, doc_id {kind}, {FOUND}")


def disclosing(docs: DataFrame, table: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """(entity, term, whole) of the pairs that reach the threshold; ``table`` is ``found`` of the same documents."""
    holders = table.where(F.size("entities") > 0).select("key", "body", F.explode("entities").alias("entity")).distinct()
    # Counts by document; support by different texts.  A document counts a pair once.
    entity = stored(
        holders.groupBy("entity", "body").agg(F.count(F.lit(1)).alias("docs"))
        .groupBy("entity").agg(F.sum("docs").alias("entity_docs"), F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") >= support).select("entity", "entity_docs"), "pii-entities")
    # Only documents with an entity of enough support are paired with their words.
    own = holders.join(entity, "entity").groupBy("key").agg(F.collect_list("entity").alias("own"))
    once = (
        table.where(F.size("entities") > 0).select("key", "body", F.array_distinct("words.term").alias("terms")).join(own, "key")
        .select("key", "body", "own", F.explode("terms").alias("term"))
        .select("key", "body", F.explode("own").alias("entity"), "term").distinct()
    )
    both = (
        once.groupBy("entity", "term", "body").agg(F.count(F.lit(1)).alias("docs"))
        .groupBy("entity", "term").agg(F.sum("docs").alias("pair_docs"), F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") >= support).join(entity, "entity")
    )
    both = stored(both.select("entity", "term", "entity_docs", "pair_docs"), "pii-pairs")
    counts = term_counts(docs, both.select("term").distinct())
    total = table.count()
    return stored(
        both.join(counts, "term")
        .withColumn("given", F.least(F.lit(1.0), F.col("pair_docs") / F.col("term_docs")))
        .withColumn("information", -F.log2(F.col("entity_docs") / F.lit(float(max(total, 1)))))
        .where((F.col("information") > 0) & (1 + F.log2("given") / F.col("information") >= threshold))
        .select("entity", "term", (F.col("given") >= 1.0).alias("whole")), "pii-disclosing")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, term_docs): documents that hold each of ``terms``, counted over all texts.

    A bitmap of fixed size tells tasks which words to count; each task adds up its own."""
    spark = docs.sparkSession
    bit = F.shiftrightunsigned("term", 64 - FILTER_BITS) + 1  # Spark's bitmaps count from 1
    maps = (
        terms.select(bit.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # at most 2 ** FILTER_BITS bits
    )
    wanted = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in maps:
        wanted[(r.bucket - 1) * 4096: r.bucket * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    shared = spark.sparkContext.broadcast(wanted)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits, counts = shared.value, {}
        if bits.any():
            seen: dict[str, int | None] = {}
            for b in batches:
                for t in b.column(0).to_pylist():
                    for w in set(WORD.findall(t.lower())) if t else ():
                        h = seen.get(w, 0)
                        if h == 0:
                            h = _hash(w)
                            x = (h & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
                            h = h if bits[x >> 3] >> (x & 7) & 1 else None
                            if len(seen) < 500_000:
                                seen[w] = h
                        if h is not None:
                            counts[h] = counts.get(h, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    partial = docs.select("text").mapInArrow(rows, "term long, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("term_docs")).join(terms, "term", "left_semi")


def term_spans(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, terms): the revealing terms of each document, as (start, end, whole)."""
    holds = table.where(F.size("entities") > 0)
    revealing = (
        holds.select("key", F.explode("entities").alias("entity")).join(pairs, "entity")
        .groupBy("key", "term").agg(F.max("whole").alias("whole"))
    )
    words = holds.join(revealing.select("key").distinct(), "key", "left_semi").select("key", F.explode("words").alias("x")).select("key", "x.*")
    return (
        words.join(revealing, ["key", "term"]).groupBy("key", "start", "end").agg(F.max("whole").alias("whole"))
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "whole"))).alias("terms"))
    )


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_sha256, spans) of every row of ``docs`` (doc_id, text)."""
    table = stored(found(docs), "pii-found")
    terms = stored(term_spans(table, disclosing(docs, table)), "pii-terms")
    term = F.transform("terms", lambda t: F.struct(t["start"].alias("s"), F.lit(len(KINDS) - 1).alias("k"), t["end"].alias("e")))
    base = F.transform(F.split("base", ","), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("s"), F.array_position(F.lit(list(KINDS)), F.split(x, ":")[0]).cast("int").alias("k"),
        F.split(x, ":")[2].cast("int").alias("e")))
    everything = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x["s"].alias("s"), (x["k"] - 1).alias("k"), x["e"].alias("e"))), term))
    text = F.array_join(F.transform(everything, lambda x: F.concat_ws(
        ":", F.element_at(F.lit(list(KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return table.join(terms, "key", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("terms").isNull(), F.col("base")).otherwise(text).alias("spans"))


def replaced(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """The text with every base span as ``<KIND>``, every term as ``<TERM>`` or removed."""
    spans = [(s, e, f"<{KINDS[k].upper()}>") for s, k, e in base_spans(text)]
    spans += [(s, e, "" if whole else "<TERM>") for s, e, whole in terms]
    out, done = [], 0
    for s, e, name in sorted(spans):
        if s >= done:
            out += [text[done:s], name]
        done = max(done, e)
    return "".join([*out, text[done:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and what reveals it taken out of ``text``; ``n_chars``, if there, counts again."""
    table = stored(found(docs), "pii-found")
    terms = stored(term_spans(table, disclosing(docs, table)), "pii-terms")
    # Few documents have revealing terms: a small stored table is broadcast, a large one is joined by key.
    keyed = docs.withColumn("_pii_key", _key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    with_terms = keyed.join(terms.select(F.col("key").alias("_pii_key"), F.col("terms").alias("_pii_terms")), "_pii_key", "left")

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            names = b.schema.names
            terms_at, text_at = names.index("_pii_terms"), names.index("text")
            texts = [
                t if t is None else replaced(t, [(x["start"], x["end"], x["whole"]) for x in own or ()])
                for t, own in zip(b.column(text_at).to_pylist(), b.column(terms_at).to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(len(names)) if i != terms_at]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in names if n != "_pii_terms"])

    out = with_terms.select(*docs.columns, "_pii_terms").mapInArrow(rows, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
