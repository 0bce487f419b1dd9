"""File readers on FIXTURES.md-style files, and fuzzy candidates vs difflib."""

from __future__ import annotations

import csv
import difflib
import io
import os
import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabvet.operators import similarity
from tabvet.operators.similarity import similarity_candidates
from tabvet.sources import files as FS
from tabvet.sources import ranges


def _tree(tmp_path):
    root = tmp_path / "raw"
    for d in ("DA_display", "SA_search", "GA_web", "other"):
        (root / d).mkdir(parents=True)
    (root / "DA_display" / "a_utf8.csv").write_text("날짜,캠페인,노출수\n2024-05-03,A,\"1,234\"\n2024.05.04,B,0\n", encoding="utf-8")
    (root / "SA_search" / "a_cp949.csv").write_bytes("날짜\t캠페인\t클릭수\n2024-05-03\t검색\t12\n".encode("cp949"))
    (root / "SA_search" / "a_utf16.csv").write_bytes("날짜;비용\n2024-05-03;1,000\n".encode("utf-16"))
    (root / "GA_web" / "meta_rows.csv").write_text(
        "캠페인 성과 리포트\n기간: 2024-05\n\n날짜,캠페인,세션수\n2024-05-03,A,3,extra\n\n2024-05-04,B,4\n", encoding="utf-8")
    (root / "GA_web" / "dup_headers.csv").write_text("캠페인,캠페인,,비용\nA,B,C,1\n", encoding="utf-8")
    (root / "other" / "notes.txt").write_text("ignored", encoding="utf-8")
    FS.write_workbook(str(root / "DA_display" / "two_sheets.xlsx"),
                      {"s1": [["제목", ""], ["날짜", "캠페인", "노출수"], ["2024-05-03", "", "7"]],
                       "s2": [["캠페인", "비용"], ["X", "1,500"]]})
    return root


def test_readers_end_to_end(spark, tmp_path):
    root = _tree(tmp_path)
    files = FS.discover_files(spark, str(root))
    names = sorted(os.path.basename(r.path) for r in files.collect())
    assert names == sorted(["a_utf8.csv", "a_cp949.csv", "a_utf16.csv", "meta_rows.csv", "dup_headers.csv", "two_sheets.xlsx"])

    prof = {os.path.basename(r.path): (r.encoding, r.delimiter) for r in FS.sniff_csv_dialect(files).collect()}
    assert prof["a_cp949.csv"] == ("cp949", "\t")
    assert prof["a_utf16.csv"] == ("utf-16", ";")
    assert prof["a_utf8.csv"] == ("utf-8-sig", ",")

    rows = FS.read_delimited(FS.sniff_csv_dialect(files)).unionByName(FS.read_workbooks(files))
    got = {(os.path.basename(r.path), r.sheet, r.row_no): list(r.cells) for r in rows.collect()}
    assert got[("a_cp949.csv", None, 2)] == ["2024-05-03", "검색", "12"]
    assert got[("a_utf8.csv", None, 2)] == ["2024-05-03", "A", "1,234"]
    assert got[("two_sheets.xlsx", "s1", 3)] == ["2024-05-03", "", "7"]  # sparse cell padded
    assert got[("two_sheets.xlsx", "s2", 2)] == ["X", "1,500"]  # inline strings sheet

    hdr = {(os.path.basename(r.path), r.sheet): r.header_row_no for r in FS.detect_header_row(rows).collect()}
    assert hdr[("meta_rows.csv", None)] == 4 and hdr[("two_sheets.xlsx", "s1")] == 2 and hdr[("a_utf16.csv", None)] == 1

    # payload rows for meta_rows.csv: blank rows skipped, wide row gets extra_4
    h = FS.detect_header_row(rows)
    hc = rows.alias("r").join(h.alias("h"), (F.col("r.path") == F.col("h.path")) & F.col("r.sheet").eqNullSafe(F.col("h.sheet"))
                               & (F.col("r.row_no") == F.col("h.header_row_no")))
    widest = rows.groupBy("path", "sheet").agg(F.max(F.size("cells")).alias("w"))
    headers = hc.select("r.path", "r.sheet", "h.header_row_no", "r.cells").join(widest, ["path", "sheet"], "left").select(
        "path", "sheet", "header_row_no", FS.header_names(F.col("cells"), F.lit(0)).alias("headers"))
    pay = {(os.path.basename(r.path), r.row_no): dict(r.payload) for r in FS.rows_to_payload(rows, headers).collect()}
    assert pay[("meta_rows.csv", 5)] == {"날짜": "2024-05-03", "캠페인": "A", "세션수": "3", "extra_4": "extra"}
    assert ("meta_rows.csv", 6) not in pay
    dup = {(os.path.basename(r.path)): list(r.headers) for r in headers.collect()}
    assert dup["dup_headers.csv"] == ["캠페인", "캠페인_2", "unnamed_3", "비용"]

    prof_rows = FS.schema_profiles(files, FS.sniff_csv_dialect(files), h).collect()
    meta = [r for r in prof_rows if r.path.endswith("meta_rows.csv")][0]
    assert meta.has_metadata_rows and meta.file_format == "csv"


def test_workbook_strings_are_joined_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks of a few rows: strings of all cells, most of them used often, one book without any, a table without a header."""
    monkeypatch.setattr(FS, "BLOCK_ROWS", 4)
    rng = random.Random(5)
    books = {}
    for name in ("a", "b"):
        rows = [["캠페인", "비용", "메모"]] + [[rng.choice(["total", "x & y", " <b> "]), str(j), rng.choice(["", "합계", f"{name}{j}"])] for j in range(30)]
        books[name] = {"s1": rows, "s2": [["one"], [], ["two"]]}
    books["c"] = {"empty": [], "s2": [["only", "inline"]]}
    for name, sheets in books.items():
        FS.write_workbook(str(tmp_path / f"{name}.xlsx"), sheets)
    files = FS.discover_files(spark, str(tmp_path))
    rows = FS.read_workbooks(files)
    got = {}
    for r in rows.collect():
        got.setdefault((os.path.basename(r.path)[0], r.sheet), []).append((r.row_no, list(r.cells)))

    def stored(row):
        row = [c.strip() if c else c for c in row]
        while row and row[-1] == "":
            row = row[:-1]
        return row
    want = {(b, s): list(enumerate([stored(r) for r in rows], 1)) for b, sheets in books.items() for s, rows in sheets.items() if rows}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sum(1 for r in FS.workbook_strings(files.select("path")).collect() if r.text == "total") == 2  # once a book
    headers = {(os.path.basename(r.path)[0], r.sheet): r.header_row_no for r in FS.detect_header_row(rows).collect()}
    assert headers == {("a", "s1"): 1, ("b", "s1"): 1, ("a", "s2"): None, ("b", "s2"): None, ("c", "s2"): 1}


def test_payload_rows_of_one_table_stay_where_they_are(spark):
    """All rows of a table have one key: they are not gathered, and every cell is stripped twice at most (filter and value)."""
    rows = spark.createDataFrame([("p", None, i, [" 1 ", "", " x"][: i % 4]) for i in range(1, 9)], FS.ROWS_SCHEMA)
    headers = spark.createDataFrame([("p", None, 1, ["a", "a"])], "path string, sheet string, header_row_no long, headers array<string>")
    out = FS.rows_to_payload(rows, headers)
    want = {2: {"a": ""}, 3: {"a": "", "extra_3": "x"}, 5: {"a": ""}, 6: {"a": ""}, 7: {"a": "", "extra_3": "x"}}
    assert {r.row_no: r.payload for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_header_cells_are_stripped_once(spark):
    df = spark.createDataFrame([([" a ", "a", "", "b", "a"], 7), (["x", None], 2), (None, 1)], "header array<string>, widest int")
    named = df.select(FS.header_names(F.col("header"), F.col("widest")).alias("names"))
    assert [r.names for r in named.collect()] == [["a", "a_2", "unnamed_3", "b", "a_3", "extra_6", "extra_7"], ["x", None], None]
    # Once for the names, and for their number beside the extra ones.
    assert named._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2


def test_workbook_strings_are_never_broadcast(spark, tmp_path):
    """Few books may hold any number of strings: the list of books says nothing about their size."""
    FS.write_workbook(str(tmp_path / "a.xlsx"), {"s": [[f"t{i}", str(i)] for i in range(50)]})
    rows = FS.read_workbooks(FS.discover_files(spark, str(tmp_path)))
    rows.write.format("noop").mode("overwrite").save()
    assert sorted(r.cells[0] for r in rows.collect()) == sorted(f"t{i}" for i in range(50))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_workbook_elements_leave_their_parents(tmp_path):
    FS.write_workbook(str(tmp_path / "a.xlsx"), {"s": [[f"t{i}"] for i in range(500)]})
    with open(tmp_path / "a.xlsx", "rb") as stream:
        book = FS.Workbook(stream)
        for element in book._elements("xl/sharedStrings.xml", "si"):
            last = element
        assert last.findtext(FS.MAIN + "t") == "t499"
        with pytest.raises(KeyError):
            FS._filled(*(pd.DataFrame(x) for x in (
                {"path": ["p"], "sheet": ["s"], "row_no": [1], "cells": [["7"]], "shared": [[0]]}, {"number": [], "text": []})))


def _as_csv_reads(data: bytes, codec: str, delimiter: str) -> list[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return list(csv.reader(io.TextIOWrapper(io.BytesIO(data), encoding=codec, errors="replace", newline=""), delimiter=delimiter))


def test_ranges_read_what_csv_reads():
    """Random texts cut anywhere: quotes in and out of fields, all line ends, line ends in quotes, several codecs, bad bytes."""
    rng = random.Random(1)
    bits = ['"', '"', ",", ",", ";", "a", "bc", "é", "가", "\n", "\r", "\r\n", " ", '""', ',"x\ny"']
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40, 120])))
        codec = rng.choice(["utf-8-sig", "utf-16", "cp949"])
        data = text.replace("é", "e" if codec == "cp949" else "é").encode(codec) + b"\xff\xfe"[: rng.choice([0, 0, 0, 1, 2])]
        stream, n, step = io.BytesIO(data), len(data), rng.choice([1, 2, 3, 7, 16, 50])
        cuts = [ranges.line_start(stream, codec, at, n) for at in range(0, max(n, 1), step)] + [n]
        got, quoted = [], False
        for start, stop in zip(cuts, cuts[1:], strict=False):
            own = list(ranges.rows(stream, codec, ",", start, stop, n, quoted))
            quoted, count = ranges.transition(stream, codec, ",", start, stop, quoted)
            assert count == len(own)
            got += own
        assert got == _as_csv_reads(data, codec, ",")


@pytest.mark.parametrize("size", [64, 1000])
def test_one_file_in_many_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "RANGE_BYTES", size)
    rng = random.Random(3)
    files = {}
    for i, codec in enumerate(["utf-8-sig", "utf-16", "cp949", "utf-8"]):
        rows = [["이름", "값", "메모"]] + [[f"r{j}", str(rng.random()), rng.choice(["", 'say "hi"', "두 줄\n끝", "x" * 150, "a\r\nb, c"])] for j in range(80)]
        out = io.StringIO()
        csv.writer(out, delimiter=";" if i % 2 else ",", lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        files[f"f{i}.csv"] = (out.getvalue().encode(codec), {"utf-8": "utf-8-sig"}.get(codec, codec), rows)
    (tmp_path / "empty.csv").write_bytes(b"")
    for name, (data, _, _) in files.items():
        (tmp_path / name).write_bytes(data)
    profiles = FS.sniff_csv_dialect(FS.discover_files(spark, str(tmp_path)))
    assert {os.path.basename(r.path): r.encoding for r in profiles.collect() if "empty" not in r.path} == {k: v[1] for k, v in files.items()}
    got = {}
    for r in FS.read_delimited(profiles).collect():
        got.setdefault(os.path.basename(r.path), []).append((r.row_no, list(r.cells)))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v[2], 1)) for k, v in files.items()}


def _sim(a: str, b: str) -> float:
    n = lambda s: "".join(unicodedata.normalize("NFC", s).lower().split())
    return difflib.SequenceMatcher(None, n(a), n(b)).ratio()


def test_similarity_matches_brute_force(spark):
    terms = ["a", "sa", "campain", "노출 수", "mobile", "Brand#1", "zzzz", "광고그룹", "매체명", " ", "bing ads"]
    cands = [("column", "SA", "캠페인", "campaign", "contain", None), ("column", "SA", "노출수", "노출수", "contain", None),
             ("value", "SA", "device", "mobile web", None, None), ("value", "SA", "brand", "Brand#17", None, None),
             ("value", "SA", "brand", "Brand#12", None, None), ("column", "SA", "광고 그룹", "광고 그룹", "alias", "광고 그룹"),
             ("value", "SA", "device", "Desktop", None, None), ("column", "SA", "session source", "session source", "alias", "매체"),
             ("value", "DA", "source_channel", "bing", "alias", "bing ad"), ("value", "DA", "source_channel", "blank", None, "  ")]
    tdf = spark.createDataFrame([(t,) for t in terms], "term string")
    cdf = spark.createDataFrame(
        cands, "kind string, target_table string, column_name string, candidate string, floor_rule string, match_text string"
    ).withColumn("match_text", F.coalesce("match_text", "candidate"))
    got = {(r.term, r.candidate): r.score for r in similarity_candidates(tdf, cdf).collect()}
    expected = {}
    for t in terms:
        nt = "".join(t.lower().split())
        per_kind: dict[str, list] = {}
        for kind, _, _, cand, rule, text in cands:
            nc = "".join((text or cand).lower().split())
            if not nt or not nc:
                continue
            s = _sim(t, text or cand)
            if rule == "contain" and (nc in nt or nt in nc):
                s = max(s, 0.82)
            if s >= 0.45:
                if rule == "alias":
                    s = max(s, 0.7)
                per_kind.setdefault(kind, []).append((round(s, 3), cand))
        for kind, items in per_kind.items():
            for s, cand in sorted(items, key=lambda x: (-x[0], x[1]))[:5]:
                expected[(t, cand)] = s
    assert got == expected


def test_candidate_index_loses_no_pair(spark):
    """All pairs of random texts: everything difflib scores at the cut, and all contained texts, are found; texts without a common character never."""
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice(rng.choice(["ab", "abcdef", "가나다é", "xyz"])) for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 40]))) for _ in range(160)})
    terms, cands = texts[::2], texts[1::2] + texts[:20:2]
    t = spark.createDataFrame([(x,) for x in terms], "tk string")
    c = spark.createDataFrame([(x, "contain" if i % 2 else None) for i, x in enumerate(cands)], "ck string, floor_rule string")
    got = {(r.tk, r.ck): r.contained for r in similarity.candidate_pairs(t, c).collect()}
    for x in terms:
        for i, y in enumerate(cands):
            inside = i % 2 == 1 and (x in y or y in x)
            if inside or difflib.SequenceMatcher(None, x, y).ratio() >= 0.45:
                assert (x, y) in got
            assert not inside or got[x, y]
            assert (x, y) not in got or set(x) & set(y)


def test_character_tokens_stay_out_of_python(spark):
    """Tokens as Python would number them, made by the JVM: batches of long keys took memory in Python."""
    keys = ["", "aab", "가나가", "a😀a😀", "a.b$a\\", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "key string").withColumn("tokens", similarity._char_tokens("key"))
    assert {r.key: sorted(r.tokens) for r in df.collect()} == {k: sorted(f"{c}{k[:i + 1].count(c)}" for i, c in enumerate(k)) for k in keys}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_candidate_index_has_no_all_pairs_join(spark):
    terms = spark.createDataFrame([("a",)], "tk string")
    catalog = spark.createDataFrame([("b", "contain")], "ck string, floor_rule string")
    plan = similarity.candidate_pairs(terms, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recommendations_keep_the_best_row(spark):
    """An identity found under its own name and under an alias counts once, with its better score; ties go by name."""
    tdf = spark.createDataFrame([("bing",), ("zzz",)], "term string")
    cdf = spark.createDataFrame(
        [("value", "DA", "ch", "bing", "bing", None), ("value", "DA", "ch", "bing", "bin", "alias"), ("value", "DA", "ch", "bina", "bina", None),
         ("column", "DA", "binb", "binb", "binb", "contain"), ("value", "DA", None, "binc", "binc", None)],
        "kind string, target_table string, column_name string, candidate string, match_text string, floor_rule string")
    scored = similarity.scored_candidates(tdf, cdf).cache()
    got = {r.recommended_term: (r.score, r.confidence, r.action) for r in similarity.recommendations(scored).collect()}
    assert got == {"bing": (1.0, "high", "rerun_preview"), **{x: (0.75, "medium", "rerun_preview") for x in ("bina", "binb", "binc")}}
    assert [tuple(r) for r in similarity.best_recommendation(scored).collect()] == [("bing", "bing")]
    ranks = {(r.kind, r.candidate): r.rank for r in similarity.top_recommendations(scored).collect()}
    assert ranks == {("value", "bing"): 1, ("value", "bina"): 2, ("value", "binc"): 3, ("column", "binb"): 1}
