"""Rule-based request-text jobs over tables of texts.

Keyword lists are configuration (fixed values below); every job is a Column
expression or a regex split, evaluated in the JVM over whole texts.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.fixed_values import (  # fixed values, kept together in fixed_values.py
    DERIVED_KEYWORDS,
    UPDATE_TERMS,
    AGGREGATE_KEYWORDS,
    DETAIL_KEYWORDS,
    NUMERIC_FIELD_ALIASES,
    DIMENSION_FIELD_ALIASES,
    GROUP_BY_MARKERS,
    NUMERIC_PRESENCE_TERMS,
    NUMERIC_ZERO_TERMS,
    EMPTY_TERMS,
    MEDIA_TABLE_TERMS,
    METRIC_TOKENS,
    AGG_WORDS,
    MONTH_PATTERN,
    UPDATE_VALUE_PATTERNS,
    FIELD_VALUE_BEFORE_VERB,
    FIELD_VALUE_NEAR,
    CORRECTION_WORD,
    CLAUSE_SPLIT,
    ASSIGNMENT_PATTERN,
    LABEL_PATTERN,
    QUOTED_PATTERN,
    REWRITE_PREFIX,
)


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def _any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


# ------------------------------------------------------------------ T1
def classify_intent(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(_any(low, DERIVED_KEYWORDS), F.lit("ADD_DERIVED_COLUMN"))
        .when(_any(compact(text), UPDATE_TERMS), F.lit("UPDATE_NUMERIC_VALUE"))
        .when(_any(low, AGGREGATE_KEYWORDS), F.lit("SELECT_AGGREGATE"))
        .when(_any(low, DETAIL_KEYWORDS), F.lit("SELECT_DETAIL"))
        .otherwise(F.lit("ASK_CLARIFICATION"))
    )


# ------------------------------------------------------------------ T2
def month_period(text: Column, default_year: int) -> Column:
    """struct(start, end) of the first 'm월' (optionally 'yyyy년 m월'); the
    default year is an explicit argument (no wall clock)."""
    y = F.regexp_extract(text, MONTH_PATTERN, 1)
    m = F.regexp_extract(text, MONTH_PATTERN, 2)
    year = F.when(y == "", F.lit(default_year)).otherwise(y.cast("int"))
    month = F.when(m == "", F.lit(None).cast("int")).otherwise(m.cast("int"))
    ok = month.between(1, 12)
    start = F.when(ok, F.make_date(year, month, F.lit(1)))
    return F.struct(F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(F.last_day(start), "yyyy-MM-dd").alias("end"))


# ------------------------------------------------------------------ T3
def update_value(text: Column) -> Column:
    out = None
    for p in UPDATE_VALUE_PATTERNS:
        v = F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
        out = v if out is None else F.coalesce(out, v)
    return F.regexp_replace(out, ",", "")


#: Stands in front of every field name of a marked text.
MARK = "\x01"


def field_name_regex(fields: Mapping[str, Sequence[str]]) -> str:
    """Any name of any field, longer ones first."""
    names = {*fields, *(n for own in fields.values() for n in own)}
    return "(" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + ")"


def field_value_regexes(alias: str) -> list[str]:
    """Patterns on a marked text, in order of preference at one mention; neither reaches over the next field name."""
    return [p.replace("[^,.;", f"[^{MARK},.;").replace("{alias}", re.escape(alias)) for p in (FIELD_VALUE_BEFORE_VERB, FIELD_VALUE_NEAR)]


def field_mention_regex(alias: str) -> str:
    """Either pattern: group 1 or group 2 is the value of the first mention that has one."""
    return "|".join(field_value_regexes(alias))


def field_update_values(text: Column, fields: Mapping[str, Sequence[str]] = NUMERIC_FIELD_ALIASES) -> Column:
    """T3, field by field: array<struct(field, value)> of the fields that the text gives a value.

    A field's value stands behind one of its names and before the next name of any
    field, so "cost 500, clicks 3" gives each its own. The names are marked once; a name
    that the text holds then costs one linear scan. A field that is named without a value
    in a text that asks for a correction is set to 0. A NULL text names no field; a control
    character 1 in a text counts as a blank.
    """
    every = {*fields, *(n for own in fields.values() for n in own)}
    first = "(?=[" + "".join(re.escape(c) for c in sorted({n[0] for n in every})) + "])"
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), first + field_name_regex(fields), MARK + "$1")
    # The text without blanks matters only if it holds the characters of the correction word.
    asks = functools.reduce(operator.and_, (F.contains(text, F.lit(c)) for c in sorted(set(CORRECTION_WORD))))
    short = F.when(asks, compact(text))

    def found(x: Column) -> Column:
        marked, short, corrects = x["marked"], x["short"], x["corrects"]
        values = []
        for field, names in fields.items():
            tries = []
            for alias in dict.fromkeys([field, *names]):
                mention = field_mention_regex(alias)
                first_of = F.coalesce(*[F.nullif(F.regexp_extract(marked, mention, g), F.lit("")) for g in (1, 2)])
                tries.append(F.when(F.contains(marked, F.lit(alias)), first_of))
                tries.append(F.when(corrects & F.contains(short, F.lit(re.sub(r"\s+", "", alias).lower())), F.lit("0")))
            values.append(F.struct(F.lit(field).alias("field"), F.regexp_replace(F.coalesce(*tries), ",", "").alias("value")))
        return F.filter(F.array(*values), lambda v: v["value"].isNotNull())

    once = _with(short, lambda s: F.struct(marked.alias("marked"), s.alias("short"),
                                           F.coalesce(F.contains(s, F.lit(CORRECTION_WORD)), F.lit(False)).alias("corrects")))
    return _with(once, found)


# ------------------------------------------------------------------ T4
def split_clauses(df: DataFrame, text_col: str, key: Sequence[str]) -> DataFrame:
    """(key, clause_no, clause): non-blank trimmed clauses, numbered from 1; row by row, without a shuffle."""
    parts = F.transform(F.split(F.col(text_col), CLAUSE_SPLIT), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    kept = df.select(*key, F.posexplode(F.filter(parts, lambda c: c != "")).alias("pos", "clause"))
    return kept.select(*key, (F.col("pos") + 1).cast("long").alias("clause_no"), "clause")


# ------------------------------------------------------------------ T5
def _alt(words: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def field_term_regex(aliases: Sequence[str], terms: Sequence[str]) -> str:
    toks = [re.sub(r"\s+", "", a).lower() for a in aliases]
    terms = [re.sub(r"\s+", "", t).lower() for t in terms]
    return _alt(toks) + ".{0,8}" + _alt(terms)


CONDITION_GROUPS = (("is_empty", EMPTY_TERMS), ("eq_zero", NUMERIC_ZERO_TERMS), ("gt_zero", NUMERIC_PRESENCE_TERMS))


def presence_conditions(text: Column, fields: Mapping[str, Sequence[str]] = NUMERIC_FIELD_ALIASES) -> Column:
    """array<struct(field, operator)>: a field followed within 8 characters by an
    empty / zero / presence term (first group in that order wins per field)."""
    c = compact(text)
    items = []
    for field, aliases in fields.items():
        op = None
        for name, terms in CONDITION_GROUPS:
            hit = c.rlike(field_term_regex(aliases, terms))
            op = F.when(hit, F.lit(name)) if op is None else op.when(hit, F.lit(name))
        items.append(F.struct(F.lit(field).alias("field"), op.alias("operator")))
    return F.filter(F.array(*items), lambda s: s["operator"].isNotNull())


# ------------------------------------------------------------------ T6
def media_segments(df: DataFrame, text_col: str, key: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """Cut the text at media markers; score each table by the metric tokens found
    in its segments; keep the table(s) with the best positive score."""
    markers = [(t, table) for table, terms in MEDIA_TABLE_TERMS.items() for t in terms]
    marker_re = "(" + "|".join(re.escape(t) for t, _ in markers) + ")"
    cut = F.split(F.regexp_replace(F.col(text_col), marker_re, "\u0001$1"), "\u0001")

    def table_of(seg: Column) -> Column:
        return F.coalesce(*[F.when(seg.startswith(t), F.lit(table)) for t, table in markers])

    def found(seg: Column) -> Column:
        c = compact(seg)
        return sum(F.when(c.contains(re.sub(r"\s+", "", t).lower()), F.lit(1)).otherwise(F.lit(0)) for t in tokens)

    # All within the row: a segment counts once, a table has the sum of its segments.
    segs = F.transform(F.array_distinct(F.slice(cut, F.lit(2), F.size(cut))), lambda x: F.struct(table_of(x).alias("table"), found(x).alias("n")))
    staged = df.select(*key, segs.alias("_segs"))

    def total(table: str) -> Column:
        own = F.filter("_segs", lambda x: x["table"] == table)
        return F.struct(F.lit(table).alias("table"), F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("score"))

    totals = [total(table) for table in MEDIA_TABLE_TERMS]
    staged = staged.select(*key, F.array(*totals).alias("_totals"))
    best = F.array_max(F.transform("_totals", lambda x: x["score"]))
    kept = F.filter("_totals", lambda x: (x["score"] == best) & (x["score"] > 0))
    return staged.select(*key, F.inline(kept))


# ------------------------------------------------------------------ T7
def metric_mentions(text: Column) -> Column:
    """array<struct(kind, field, expression_type, alias)>: a sum / avg metric for
    every numeric field named with 합계 / 평균, and group-by rows for the
    explicit '...별' / '...기준' wording."""
    c = compact(text)
    items = []
    for field, aliases in NUMERIC_FIELD_ALIASES.items():
        named = _any(c, [re.sub(r"\s+", "", a).lower() for a in aliases])
        for word, kind in AGG_WORDS.items():
            items.append(F.when(named & c.contains(word), F.struct(
                F.lit("metric").alias("kind"), F.lit(field).alias("field"), F.lit(kind).alias("expression_type"),
                F.lit(f"{field} {word}").alias("alias"))))
    for field, markers in GROUP_BY_MARKERS:
        items.append(F.when(_any(c, markers), F.struct(
            F.lit("group_by").alias("kind"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("expression_type"),
            F.lit(field).alias("alias"))))
    return F.filter(F.array(*items), lambda s: s.isNotNull())


# ------------------------------------------------------------------ T8
#: What both label patterns begin their first phrase with.
PHRASE_END = "{2,40}?"
PHRASE_CHARS = 40


def _near_tail(text: Column, pattern: str) -> Column:
    """struct(one, two): the groups of a label pattern's first match, '' without one.

    Tried at every character with every length, the pattern's leading phrase is slow.
    What stands behind the phrase (the tail) is found in one linear scan; no match
    begins farther before the first tail than the phrase and its blank are long, so
    the whole pattern is tried from there on. Two characters more are kept, so that
    the cut is never taken for the text's start."""
    tail = pattern.partition(PHRASE_END)[2].replace(")", "", 1)  # its first bracket closes the phrase's group

    def groups(parts: Column) -> Column:
        near = F.substring(text, F.greatest(F.length(parts[0]) - (PHRASE_CHARS + 2), F.lit(1)), F.length(text))
        one, two = (F.when(F.size(parts) > 1, F.regexp_extract(near, pattern, g)).otherwise(F.when(text.isNotNull(), F.lit(""))) for g in (1, 2))
        return F.struct(one.alias("one"), two.alias("two"))
    return _with(F.split(text, tail, 2), groups)


def derived_label(text: Column) -> Column:
    """struct(derived_key, derived_value) from back-quoted tokens and label phrases."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTED_PATTERN), 1)
    q_last = F.when(F.size(quoted) > 0, F.trim(F.element_at(quoted, -1)))
    q_first = F.when(F.size(quoted) >= 2, F.trim(F.element_at(quoted, 1)))

    def norm(x: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))

    def label(found: Column) -> Column:
        a_key, a_val, l_val, l_key_raw = (norm(found[f"{p}_{g}"]) for p, g in (("a", "one"), ("a", "two"), ("l", "one"), ("l", "two")))
        l_key = F.when(l_key_raw == "값", F.lit("derived_label")).otherwise(l_key_raw)
        key = F.coalesce(a_key, l_key, q_first,
                         F.when(text.contains("광고상품"), F.lit("광고상품명")).when(text.contains("구분 항목"), F.lit("구분 항목")),
                         F.lit("derived_label"))
        value = F.coalesce(q_last, a_val, l_val)
        return F.struct(key.alias("derived_key"), value.alias("derived_value"))

    both = _with(_near_tail(text, ASSIGNMENT_PATTERN), lambda a: _with(_near_tail(text, LABEL_PATTERN), lambda x: F.struct(
        a["one"].alias("a_one"), a["two"].alias("a_two"), x["one"].alias("l_one"), x["two"].alias("l_two"))))
    return _with(both, label)


# ------------------------------------------------------------------ T9
def recommend_rewrite(text: Column, original: Column, recommended: Column) -> Column:
    o, r = F.trim(original), F.trim(recommended)
    return (
        F.when((o != "") & (r != "") & text.contains(o), F.replace(text, o, r))
        .when(r != "", F.concat_ws("\n", F.nullif(text, F.lit("")), F.concat(F.lit(REWRITE_PREFIX), r)))
        .otherwise(text)
    )
