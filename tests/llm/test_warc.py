from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tabvet.llm import warc


def expected(rows, least=0):
    groups = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            groups.setdefault(data, []).append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [i for i in groups.get(data, []) if i is not None]
        first = max(ids, default=None)
        revisit = len(groups.get(data, [])) > 1 and first is not None and page_id != first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nPage-ID: 77\r\nContent-Length: 5\r\n\r\nhello"
ROWS = [
    (1, "http://a.example/x?y=1#z", "<p>é</p>"), (2, None, None), (3, "", ""), (4, "u\r\nEvil: 1\r\n\r\n", "<p>é</p>"),
    (5, "b", "text\r\n\r\n" + MAGIC + "\r\n\r\nafter"), (6, "b", MAGIC), (7, "c", "\r\n\r\n" + MAGIC + "\r\n\r\n" + MAGIC),
    (8, "c", "ends\r\n\r\n"), (9, "c", "\r\n\r\nWARC/1.1\r\n"), (10, "c", "WARC/1.1\r\n"), (11, "c", "\r\n"), (12, "d", "x" * 7_000),
    (None, "e", "no id"), (13, "e", "no id"), (None, "f", "alone"), (14, "g", "<p>é</p>"), (14, "g", "<p>é</p>"), (15, "h", "😀" * 50),
    (20, "i", "one payload"), (20, "i", "another one"), (18, "i", "one payload"), (19, "i", "another one"),
]


@pytest.mark.parametrize("split", ["128m", "997b"])
@pytest.mark.parametrize("least", [0, 9])
def test_magic_in_payloads_and_splits_anywhere(spark, split, least):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, digest string, bytes long")
    path = warc.write(pages.coalesce(1), least)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert result(warc.verified(spark, path)) == expected(ROWS, least)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_are_plain_warc(spark, tmp_path):
    path = warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), 0, str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    records, at = 0, 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        at = stop + 4 + int(fields[b"Content-Length"])
        assert data[at:at + 4] == b"\r\n\r\n"
        at, records = at + 4, records + 1
    assert records == len(ROWS) and path.endswith("w")


def test_payloads(spark):
    path = warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), 1_000_000)
    got = sorted((r.page_id or 0, bytes(r.payload)) for r in warc.read(spark, path).collect())
    assert got == sorted((i or 0, (h or "").encode()) for i, _, h in ROWS)


def test_empty_table(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").where(F.lit(False))
    assert warc.verified(spark, warc.write(pages)).count() == 0


def test_query_table(spark, sf):
    from tabvet.llm.q_pages import op8_warc

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(op8_warc(spark, sf)) == expected(rows)
