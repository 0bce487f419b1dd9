"""Text jobs (Java regex inside Spark) against the same fixed patterns applied
with Python's ``re`` to the same request texts (brute force, small fixture)."""

from __future__ import annotations

import calendar
import random
import re

import pytest
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.operators import textjobs as T
from tabvet.queries import q_text as QT


@pytest.fixture(scope="module")
def requests(spark, sf):
    return {(r.conv_id, r.turn): r.request for r in QT._requests(spark, sf).collect()}


def _by_key(df, *cols):
    return {(r.conv_id, r.turn): tuple(r[c] for c in cols) for r in df.collect()}


def test_split_clauses_matches_python(spark, sf, requests):
    got: dict = {}
    for r in QT.split_clauses(spark, sf).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.clause_no, r.clause))
    for key, text in requests.items():
        expected = [c.strip() for c in re.split(FV.CLAUSE_SPLIT, text) if c.strip()]
        assert [c for _, c in sorted(got.get(key, []))] == expected, key


def test_month_period_matches_python(spark, sf, requests):
    got = _by_key(QT.extract_month_period(spark, sf), "start_date", "end_date")
    for key, text in requests.items():
        m = re.search(FV.MONTH_PATTERN, text)
        exp = (None, None)
        if m:
            year = int(m.group(1) or QT.DEFAULT_YEAR)
            month = int(m.group(2))
            if 1 <= month <= 12:
                last = calendar.monthrange(year, month)[1]
                exp = (f"{year}-{month:02d}-01", f"{year}-{month:02d}-{last:02d}")
        assert got[key] == exp, key


def test_update_value_matches_python(spark, sf, requests):
    got = _by_key(QT.extract_update_value(spark, sf), "update_value")
    for key, text in requests.items():
        exp = None
        for p in FV.UPDATE_VALUE_PATTERNS:
            m = re.search(p, text)
            if m:
                exp = m.group(1).replace(",", "")
                break
        assert got[key] == (exp,), key


def test_derived_label_matches_python(spark, sf, requests):
    got = _by_key(QT.derived_label_extract(spark, sf), "derived_key", "derived_value")
    for key, text in requests.items():
        quoted = re.findall(FV.QUOTED_PATTERN, text)
        value = quoted[-1].strip() if quoted else ""
        k = ""
        a = re.search(FV.ASSIGNMENT_PATTERN, text)
        if a:
            k = re.sub(r"\s+", " ", a.group(1)).strip()
            value = value or re.sub(r"\s+", " ", a.group(2)).strip()
        lm = re.search(FV.LABEL_PATTERN, text)
        if lm:
            lk = re.sub(r"\s+", " ", lm.group(2)).strip()
            k = k or (lk if lk != "값" else "derived_label")
            value = value or re.sub(r"\s+", " ", lm.group(1)).strip()
        if not k:
            k = quoted[0].strip() if len(quoted) >= 2 else "광고상품명" if "광고상품" in text else \
                "구분 항목" if "구분 항목" in text else "derived_label"
        assert got[key] == (k, value or None), key


def _field_value(text, field):
    """By cutting the text: what stands from a name of the field to the next name of any field."""
    every = {n for f, names in FV.NUMERIC_FIELD_ALIASES.items() for n in (f, *names)}
    short = re.sub(r"\s+", "", text).lower()
    for alias in (field, *FV.NUMERIC_FIELD_ALIASES[field]):
        for at in [i for i in range(len(text)) if text.startswith(alias, i)]:
            after = at + len(alias)
            stop = min([i for n in every if (i := text.find(n, after)) >= 0], default=len(text))
            for pattern in (FV.FIELD_VALUE_BEFORE_VERB, FV.FIELD_VALUE_NEAR):
                if m := re.match(pattern.replace("{alias}", re.escape(alias)), text[at:stop]):
                    return m.group(1).replace(",", "")
        if re.sub(r"\s+", "", alias).lower() in short and FV.CORRECTION_WORD in short:
            return "0"
    return None


def test_field_update_values_by_cutting_the_text(spark, sf, requests):
    got = {}
    for r in QT.field_update_values(spark, sf).collect():
        got[r.conv_id, r.turn, r.field] = r.update_value
    want = {(*k, f): v for k, t in requests.items() for f in FV.NUMERIC_FIELD_ALIASES if (v := _field_value(t, f)) is not None}
    assert got == want and len(want) > 10


def test_two_fields_with_values_of_their_own(spark):
    rng = random.Random(9)
    names = [n for f, own in FV.NUMERIC_FIELD_ALIASES.items() for n in (f, *own)]
    bits = [*names, *names, "500", "-1,234.5", "3", "원", "회", "으로", "로", " ", " ", ", ", "을", "은", "보정", "수정", "변경", ". ", "그리고", "광고비용", "x" * 12]
    texts = ["비용 500원으로, 클릭 3회로 변경", "노출수를 1,200으로 수정하고 세션은 7로 고정", "비용 클릭 3으로 변경", "광고비용 500원으로", "비용 보정", "", None,
             "a\x01b 비용 5로", "cost " + "long text " * 20_000 + "clicks 9로"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: {v.field: v.value for v in r.found} for r in df.select("id", T.field_update_values(F.col("text")).alias("found")).collect() if r.found}
    want = {i: v for i, t in enumerate(texts) if t and (v := {f: x for f in FV.NUMERIC_FIELD_ALIASES if (x := _field_value(t, f)) is not None})}
    assert got == want
    assert got[0] == {"비용": "500", "클릭수": "3"} and got[1] == {"노출수": "1200", "세션수": "7"} and got[2] == {"클릭수": "3"}
    assert sum(len(v) > 1 for v in want.values()) > 50


def test_label_patterns_start_near_their_tails(spark):
    """Groups as Python finds them, also behind long texts, where every character was tried as a start."""
    rng = random.Random(3)
    bits = ["값", "값을", "를", " ", "  ", "\n", "가나", "a" * 20, "b" * 17, "x", "에", "로", "으로", "붙", "기입", "상태 값", "분류값", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(4, 30))) for _ in range(3000)]
    texts += ["word " * 4_000 + t for t in texts[:300]] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for pattern in (FV.ASSIGNMENT_PATTERN, FV.LABEL_PATTERN):
        got = {r.id: (r.x.one, r.x.two) for r in df.select("id", T._near_tail(F.col("text"), pattern).alias("x")).collect()}
        found = [re.search(pattern, t) if t is not None else None for t in texts]
        assert got == {i: (None, None) if t is None else m.groups() if m else ("", "") for i, (t, m) in enumerate(zip(texts, found, strict=True))}
        assert sum(m is not None for m in found) > 50


def test_fields_without_a_name_are_not_scanned(spark):
    """The text is marked and compacted once each, not once a name."""
    df = spark.createDataFrame([(1, "비용 500원으로, 보 정 클 릭")], "id long, text string")
    out = df.select(T.field_update_values(F.col("text")).alias("found"))
    assert [(v.field, v.value) for v in out.collect()[0].found] == [("클릭수", "0"), ("비용", "500")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\s+") < 200 and plan.count("regexp_replace(text") + plan.count("regexp_replace(replace(text") <= 4
