"""Scalar semantics (D1-D15) and the predicate compiler."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from tabvet.functions import semantics as S
from tabvet.operators import metrics as M
from tabvet.operators import predicates as P


def col_values(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_num_strips_commas_and_nulls_bad_text(spark):
    out = col_values(spark, ["1,234", "", None, "abc", "0.00", "12.345"], lambda c: S.num(c).cast("double"))
    assert out == [1234.0, None, None, None, 0.0, 12.35]


def test_parse_number_etl_rules(spark):
    vals = ["1,234", "-", "total", " 12.5 ", "$7", "12%", ".", "", None, "1-2"]
    assert col_values(spark, vals, S.parse_number) == [1234.0, None, None, 12.5, 7.0, 12.0, None, None, None, None]


def test_parse_date_formats_and_invalid(spark):
    vals = ["2024-05-03", "2024.05.03", "2024. 5. 3.", "20240503", "2024/05/03", "2024-02-30", "2024년 5월 3일", "total"]
    text = col_values(spark, vals, S.parse_date_text)
    assert text == ["2024-05-03", "2024-05-03", "2024-05-03", "2024-05-03", None, "2024-02-30", "2024-05-03", None]
    typed = col_values(spark, vals, lambda c: F.date_format(S.parse_date(c), "yyyy-MM-dd"))
    assert typed[5] is None and typed[0] == "2024-05-03"


def test_device_group(spark):
    vals = ["mobile", " MO ", "Desktop", "pc", "iPad Tablet", "태블릿", "smart tv", "", None]
    assert col_values(spark, vals, S.device_group) == ["MO", "MO", "PC", "PC", "TABLET", "TABLET", "smart tv", None, None]


@pytest.mark.parametrize("text", ["Café  Au Lait", "é̀x", "각 한글", "plain ascii", "Å", "ﬁ"])
def test_normalize_term_matches_python(spark, text):
    expected = "".join(unicodedata.normalize("NFC", text).lower().split())
    assert col_values(spark, [text], S.normalize_term) == [expected]


def test_nfc_gate_covers_every_unstable_code_point(spark):
    unstable = [chr(cp) for cp in range(0x20, 0x30000) if not 0xD800 <= cp <= 0xDFFF
                and (unicodedata.normalize("NFC", chr(cp)) != chr(cp) or unicodedata.normalize("NFC", "e" + chr(cp)) != "e" + chr(cp))]
    df = spark.createDataFrame([(u,) for u in unstable], "s string")
    assert df.where(~F.col("s").rlike(S.NFC_UNSTABLE)).count() == 0


def test_d3_numeric_vs_text_compare(spark):
    df = spark.createDataFrame([("0.00", "0"), ("0", "1"), ("", "0")], "cost string, flag string")
    cols = df.columns
    eq0 = df.where(P.compile_condition({"field": "cost", "operator": "eq", "values": ["0"]}, cols, ("cost",))).count()
    in01 = df.where(P.compile_condition({"field": "cost", "operator": "in", "values": ["0", "1"]}, cols, ())).count()
    assert eq0 == 2  # numeric compare: '0.00' and '0' both match
    assert in01 == 1  # IN always compares text
    # eq with several values becomes IN
    assert df.where(P.compile_condition({"field": "flag", "operator": "eq", "values": ["0", "1"]}, cols)).count() == 3


def test_condition_errors_and_recovery(spark):
    cols = ["a", "b"]
    with pytest.raises(P.ConditionError):
        P.compile_condition({"field": "zzz", "operator": "eq", "values": ["1"]}, cols)
    with pytest.raises(P.ConditionError):
        P.compile_condition({"operator": "or", "conditions": []}, cols)
    df = spark.createDataFrame([("x", "y"), ("z", "y")], "a string, b string")
    rec = P.compile_condition({"field": "a", "operator": "or", "values": ["x", "q"], "conditions": []}, cols)
    assert df.where(rec).count() == 1


def test_like_wildcards_kept(spark):
    df = spark.createDataFrame([("grp-2",), ("grpX2",), ("grp2",)], "g string")
    c = P.compile_condition({"field": "g", "operator": "contains", "values": ["grp_2"]}, ["g"])
    assert sorted(r[0] for r in df.where(c).collect()) == ["grp-2", "grpX2"]


def test_guarded_ratio_null_vs_zero(spark):
    df = spark.createDataFrame([("a", "1", "0"), ("b", "1", None), ("c", "2", "4")], "k string, n string, d string")
    out = M.aggregate(df, ["k"], [{"alias": "r", "expression_type": "conversion_rate", "source_column": "n",
                                   "denominator_column": "d", "zero_fallback": 0}])
    got = {r["k"]: r["r"] for r in out.collect()}
    assert got == {"a": 0.0, "b": None, "c": 50.0}  # D5: NULL denominator stays NULL


def test_or_recovery_and_prune():
    conds = [{"field": "a", "operator": "gt", "values": ["5"]}, {"field": "b", "operator": "gt", "values": ["5"]},
             {"field": "c", "operator": "eq", "values": ["x"]}]
    out = P.or_recovery(conds)
    assert out[0]["operator"] == "or" and len(out[0]["conditions"]) == 2 and out[1]["field"] == "c"
    pruned = P.prune_unknown_conditions([{"conditions": conds}], ["a", "c"])
    assert [c["field"] for c in pruned[0]["conditions"]] == ["a", "c"]


def test_unknown_channels_are_refused_and_collation_folds(spark):
    df = spark.createDataFrame([("a", "Café "), ("b", "CAFE"), ("b", "cafés")], "source_channel string, v string")
    P.require_channels(df, ["a", "b"])
    with pytest.raises(P.ConditionError, match="zz"):
        P.require_channels(df, ["a", "zz"])
    assert df.where(P.case_insensitive_eq("v", "café")).count() == 2


def test_pruned_group_keeps_its_known_children():
    known = {"field": "a", "operator": "eq", "values": ["1"]}
    gone = {"field": "zz", "operator": "eq", "values": ["1"]}
    groups = [{"conditions": [{"operator": "or", "conditions": [known, gone, {"operator": "and", "conditions": [gone]}]},
                              {"operator": "or", "conditions": [gone]}, gone]}]
    assert P.prune_unknown_conditions(groups, ["a"]) == [{"conditions": [{"operator": "or", "conditions": [known]}]}]


def test_flatten_opens_maps_with_the_keys_of_any_row(spark):
    from tabvet.operators.normalize import flatten_structs

    schema = "id int, before map<string, string>, deep map<string, map<string, struct<x: int>>>, a struct<m: map<string, int>, n: int>, none map<string, int>"
    rows = [(1, {"b": "1", "a": None}, {"k": {"y": (5,), "x": (6,)}}, ({"p": 1}, 2), {}), (2, None, {"j": None}, None, None),
            (3, {"c.d": "9"}, {}, (None, 4), {})]
    flat = flatten_structs(spark.createDataFrame(rows, schema))
    assert flat.columns == ["id", "before.a", "before.b", "before.c.d", "deep.k.x.x", "deep.k.y.x", "a.m.p", "a.n"]
    assert sorted(tuple(r) for r in flat.collect()) == [
        (1, None, "1", None, 6, 5, 1, 2), (2, None, None, None, None, None, None, None), (3, None, None, "9", None, None, None, 4)]
    assert flatten_structs(spark.createDataFrame([], schema)).columns == ["id", "a.n"]
