"""I-Match document fingerprints over randomised lexicons (operator 4).

The lexicon are the terms whose share of documents lies in a band, so their
inverse document frequency is neither low (function words) nor high (typing
errors).  A lower bound on the share bounds the lexicon's size: documents hold
``terms per document / LOW`` such terms at most, whatever their number. It is
broadcast up to ``LEXICON_ROWS`` counted rows; beyond them its band is shuffled.  Near copies that hold more than the band's upper
share of the rows lift all their terms out of the band, so a second, wider band
lies above it: one in ``THIN`` of the more frequent terms, by their hash.  A text
with fewer than ``FEW`` terms of the band takes the terms of both; the bound on
the lexicon's size holds for both together.  Several random subsets of the
lexicon, from half of it down to 1/256, give one part of the fingerprint each:
the hash of the document's distinct terms of the subset, sorted.  Sparse subsets survive edits
of long texts, dense ones tell short texts apart.  The likeness of two
fingerprints is the share of equal parts among those that are not empty in
both.

Documents follow one another by id.  Each looks at its successor inside a
bucket of neighbouring ids; the first document of the next bucket is put at the
end of each bucket, so no order over all rows is ever needed.

Defined results: a null text is an empty text; a text without lexicon terms
(of a language below ``LOW`` of the rows, for one) has the hash of the whole text
as its fingerprint (likeness 1 if equal, else 0);
equal ids are ordered by text, null ids come first; a single document is its
own successor; extra columns are ignored; an empty table gives an empty result.
Only DataFrame functions run here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import shuffle_partitions, stored, words

#: Band of the share of documents that hold a term; always at least two documents.
LOW, HIGH = 0.001, 0.01
#: A text with fewer terms of the band takes the wider band too, which holds one in THIN of the terms above the band.
FEW, THIN = 4, 8
#: Rows of the lexicon (some 60 bytes each) up to which it is broadcast.
LEXICON_ROWS = 1_000_000
#: Byte thresholds of the subsets: a term is in subset k if byte k of its hash is below the k-th one.
SUBSETS = tuple(256 >> (1 + k % 8) for k in range(16))
#: Hex digits of a part.
PART_DIGITS = 10


def term_key(term: Column) -> Column:
    """The first 60 bits of a term's MD5."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 15), 16, 10).cast("long")


def terms(text: Column) -> Column:
    """Distinct terms of a text, case folded."""
    return F.array_distinct(words(F.lower(text)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, key, narrow, mask) of the terms in the band (narrow) and in the wider one; bit k of the mask stands for subset k."""
    n = docs.count()
    digest = F.md5(F.col("key").cast("string").cast("binary"))
    inside = [
        F.when(F.substring(digest, 2 * k + 1, 2) < F.lit(f"{t:02x}"), F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(SUBSETS)]
    return (
        docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= max(2.0, low * n))
        .select("term", term_key(F.col("term")).alias("key"), (F.col("df") <= max(2.0, high * n)).alias("narrow"))
        .where(F.col("narrow") | (F.col("key") % THIN == 0)).select("term", "key", "narrow", sum(inside[1:], inside[0]).alias("mask"))
    )


def _bucket(order: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``order``, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds)
    rounds = math.ceil(math.log2(len(bounds) + 1))
    # lo bounds are known to be at or below, those from hi on are known to be above.
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda a, _: F.when(a["lo"] >= a["hi"], a).otherwise(
            F.when(F.element_at(table, F.floor((a["lo"] + a["hi"]) / 2).cast("int") + 1) <= order,
                   F.struct((F.floor((a["lo"] + a["hi"]) / 2).cast("int") + 1).alias("lo"), a["hi"].alias("hi")))
            .otherwise(F.struct(a["lo"].alias("lo"), F.floor((a["lo"] + a["hi"]) / 2).cast("int").alias("hi")))))
    return found["lo"]


def successors(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket`` and ``place``, the successor's ``next_bucket``, ``next_place`` and ``next_text``."""
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    buckets = 4 * shuffle_partitions(spark)
    cuts = docs.select(order.alias("o")).agg(F.percentile_approx("o", [i / buckets for i in range(1, buckets)], 50 * buckets)).collect()
    bounds = sorted({int(b) for b in cuts[0][0] or []})  # at most as many as buckets
    placed = docs.select("doc_id", "text", order.alias("o")).withColumn("bucket", _bucket(F.col("o"), bounds))
    firsts = placed.groupBy("bucket").agg(F.min("o").alias("o"))
    along = Window.orderBy("bucket")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per bucket.
    firsts = stored(firsts.select(
        "bucket", "o", F.coalesce(F.lag("bucket").over(along), F.max("bucket").over(whole)).alias("before")), "imatch-firsts")
    guests = (
        placed.join(F.broadcast(firsts), ["bucket", "o"]).groupBy("bucket", "before").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(0).cast("long").alias("o"),
                F.col("before").alias("bucket"), F.col("bucket").alias("home"))
    )
    rows = placed.withColumn("home", F.lit(None).cast("int")).unionByName(guests)
    by_id = Window.partitionBy("bucket").orderBy(F.col("home").isNotNull(), "o", "text")
    rows = rows.withColumns({
        "place": F.row_number().over(by_id), "next_text": F.lead("text").over(by_id), "next_home": F.lead("home").over(by_id)})
    return rows.where(F.col("home").isNull()).select(
        "doc_id", "text", "bucket", "place", F.coalesce("next_home", "bucket").alias("next_bucket"),
        F.when(F.col("next_home").isNull(), F.col("place") + 1).otherwise(F.lit(1)).alias("next_place"), "next_text")


def _marked(single: DataFrame, lex: DataFrame) -> DataFrame:
    """The rows of ``single`` whose term is in the lexicon or blank, with key, narrow and mask."""
    blank = single.sparkSession.range(1).select(
        F.lit(" ").alias("term"), F.lit(0).cast("long").alias("key"), F.lit(False).alias("narrow"), F.lit(0).alias("mask"))
    if lex.count() <= LEXICON_ROWS:
        return single.join(F.broadcast(lex.unionByName(blank)), "term")
    # The wider band has a tenth of the bound and the hot terms; a term of the band has at most HIGH of the rows.
    common = single.join(F.broadcast(lex.where(~F.col("narrow")).unionByName(blank)), "term")
    return common.unionByName(single.join(lex.where("narrow").hint("merge"), "term"))


def _own(found: Column, kind: int) -> Column:
    of_kind = F.filter(found, lambda x: x["kind"] == kind)
    narrow = F.filter(of_kind, lambda x: x["narrow"])
    used = F.when(F.size(narrow) < FEW, of_kind).otherwise(narrow)
    return F.sort_array(F.transform(used, lambda x: F.struct(x["key"].alias("key"), x["mask"].alias("mask"))))


def _parts(own: Column) -> Column:
    def part(k: int) -> Column:
        chosen = F.filter(own, lambda x: x["mask"].bitwiseAND(F.lit(1 << k)) != 0)
        joined = F.array_join(F.transform(chosen, lambda x: x["key"].cast("string")), ",")
        return F.when(F.size(chosen) == 0, F.lit("")).otherwise(F.substring(F.md5(joined.cast("binary")), 1, PART_DIGITS))
    return F.array(*[part(k) for k in range(len(SUBSETS))])


def _or_whole(parts: str, text_digest: str) -> Column:
    return F.when(F.array_join(parts, "") == "", F.array(F.concat(F.lit("="), F.col(text_digest)))).otherwise(F.col(parts)).alias(parts)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that are not empty in both; of whole-text hashes 1 if equal, else 0."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda x: (x["a"] != "") | (x["b"] != "")))
    same = F.size(F.filter(pairs, lambda x: (x["a"] == x["b"]) & (x["a"] != "")))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(same / used)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lex = stored(lexicon(base, low, high), "imatch-lexicon")
    rows = successors(base)
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    rows = rows.select("doc_id", "bucket", "place", "next_bucket", "next_place", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumns({"own_terms": terms(F.col("text")), "edited_terms": terms(F.col("edited"))})
    rows = rows.select(
        "doc_id", "bucket", "place", "next_bucket", "next_place", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.md5(F.col("edited").cast("binary")).alias("edited_md5"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        # A blank, which is no term of a text, keeps documents without lexicon terms.
        F.concat(
            F.array(F.struct(F.lit(-1).alias("kind"), F.lit(" ").alias("term"))),
            F.transform("own_terms", lambda t: F.struct(F.lit(0).alias("kind"), t.alias("term"))),
            F.transform("edited_terms", lambda t: F.struct(F.lit(1).alias("kind"), t.alias("term")))).alias("found"))
    single = rows.select("*", F.inline("found")).drop("found")
    # With a broadcast lexicon the rows of a bucket are in one partition already, so this groups without a further exchange.
    grouped = _marked(single, lex).groupBy(
        "bucket", "place", "doc_id", "next_bucket", "next_place", "n_chars", "text_md5", "edited_md5", "edited_sha256"
    ).agg(F.collect_list(F.struct("kind", "key", "narrow", "mask")).alias("found"))
    # One projection per step, so that what is used sixteen times is computed once.
    grouped = grouped.withColumns({"own": _own(F.col("found"), 0), "edited_own": _own(F.col("found"), 1)}).drop("found")
    grouped = grouped.withColumns({"parts": _parts(F.col("own")), "edited_parts": _parts(F.col("edited_own"))}).drop("own", "edited_own")
    out = stored(grouped.select(
        "doc_id", "bucket", "place", "next_bucket", "next_place", "n_chars", "edited_sha256",
        _or_whole("parts", "text_md5"), _or_whole("edited_parts", "edited_md5")), "imatch-parts")
    following = out.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("parts").alias("next_parts"))
    return out.join(following, ["next_bucket", "next_place"]).select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("parts", "-").alias("fingerprint"),
        F.array_join("edited_parts", "-").alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"))


def _sql() -> str:
    mask = " + ".join(f"CASE WHEN substr(h, {2 * k + 1}, 2) < '{t:02x}' THEN {1 << k} ELSE 0 END" for k, t in enumerate(SUBSETS))
    part = ", ".join(
        f"coalesce(substr(md5(string_agg(key::VARCHAR, ',' ORDER BY key) FILTER ((mask & {1 << k}) <> 0)), 1, {PART_DIGITS}), '')"
        for k in range(len(SUBSETS)))

    def near(a: str, b: str) -> str:
        return (f"CASE WHEN len({a}) <> len({b}) THEN 0.0 ELSE"
                f" len(list_filter(list_zip({a}, {b}), lambda x: x[1] = x[2] AND x[1] <> ''))"
                f" / len(list_filter(list_zip({a}, {b}), lambda x: x[1] <> '' OR x[2] <> '')) END::DOUBLE")

    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
moved AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
                 coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
          FROM base WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edit AS (SELECT doc_id, next_id, text, length(text) AS n_chars,
                substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM moved),
texts AS (SELECT doc_id, 0 AS kind, text FROM edit UNION ALL SELECT doc_id, 1, edited FROM edit),
terms AS (SELECT DISTINCT doc_id, kind, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS term FROM texts),
keyed AS (SELECT doc_id, kind, ('0x' || substr(md5(term), 1, 15))::BIGINT AS key FROM terms),
band AS (SELECT key, md5(key::VARCHAR) AS h, count(*) <= greatest(2.0, {HIGH} * (SELECT count(*) FROM base)) AS narrow
         FROM keyed WHERE kind = 0 GROUP BY key HAVING count(*) >= greatest(2.0, {LOW} * (SELECT count(*) FROM base))),
lex AS (SELECT key, narrow, {mask} AS mask FROM band WHERE narrow OR key % {THIN} = 0),
found AS (SELECT doc_id, kind, key, mask, narrow, count(*) FILTER (narrow) OVER (PARTITION BY doc_id, kind) AS n_narrow
          FROM keyed JOIN lex USING (key)),
used AS (SELECT doc_id, kind, key, mask FROM found WHERE narrow OR n_narrow < {FEW}),
parts AS (SELECT t.doc_id, t.kind, [{part}] AS p, any_value(md5(t.text)) AS m
          FROM texts t LEFT JOIN used USING (doc_id, kind) GROUP BY t.doc_id, t.kind),
final AS (SELECT doc_id, kind, CASE WHEN array_to_string(p, '') = '' THEN ['=' || m] ELSE p END AS p FROM parts)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.p, '-') AS fingerprint,
       array_to_string(b.p, '-') AS edited_fingerprint, {near('a.p', 'b.p')} AS near_edited, {near('a.p', 'c.p')} AS near_next
FROM edit e JOIN final a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN final b ON b.doc_id = e.doc_id AND b.kind = 1
JOIN final c ON c.doc_id = e.next_id AND c.kind = 0
"""


#: The same on one machine; documents with ids of their own only.
SQL = _sql()
