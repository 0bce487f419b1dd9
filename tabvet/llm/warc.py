"""WARC archives: writing, and reading by boundary-chain verification (operator 8).

Writing.  One record per page through Spark's text writer, whose line separator
is the end of a WARC record, so every file is a plain WARC file and every file
system of Spark will do.  Of the pages with equal payloads of at least
``min_bytes`` the one with the largest id is the response; the others are
revisit records without a block that name it.

Reading.  A record starts with ``WARC/1.1``; the same bytes may stand inside a
payload.  So every such place is only a candidate.  Tasks read splits of the
files, cut at the magic (which has no prefix that is also its suffix, so a cut
is found wherever a split ends), and emit for each candidate its offset and,
from its Content-Length, the offset of its successor; pointer
jumping from the start of each file doubles the reach of all pointers per
round and keeps exactly the candidates that are reachable.  The pieces of a
payload that was cut at rejected candidates are put together again.

Defined results: a null html is an empty payload; null or odd urls are written
as percent-encoded text; null page ids are written as an empty field and never
win against an id; equal ids with equal payloads are all responses if they
have the largest id; pages of one id with different payloads are told apart by
their digests; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabvet.llm.common import stored
from tabvet.session import shared_path

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Records per file at most.
FILE_RECORDS = 5_000
DATE = "2024-01-01T00:00:00Z"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    h = F.sha1(payload.cast("binary"))
    # Twenty bits (five hex digits) at a time: four digits to base 32, then to the RFC 4648 alphabet.
    groups = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uri(url: Column) -> Column:
    """A url for a header line: all but the usual signs of urls percent-encoded."""
    out = F.url_encode(url)
    for sign, code in ((":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("=", "%3D"), ("&", "%26"), ("#", "%23"), ("%", "%25")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record) text of every page: headers, empty line, block; without the record's end."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"digest": digest(F.col("html")), "bytes": F.octet_length("html").cast("long")})
    # One row per payload that several pages share; aggregated before the shuffle.
    shared = (
        base.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
        .select("digest", "bytes", "first_id")
    )
    # Stored, so that its size is known: a small table is broadcast and no payload is shuffled.
    shared = stored(shared, "warc-shared")
    joined = base.join(shared, ["digest", "bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("/", number, F.col("digest")).cast("binary"))
    urn = F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    headers = F.concat(
        F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn, F.lit(f"\r\nWARC-Date: {DATE}"),
        F.lit("\r\nWARC-Target-URI: "), _uri(F.col("url")),
        F.lit("\r\nPage-ID: "), number,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To-Page: "),
            F.col("first_id").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string"))
    return joined.select(F.concat(F.lit(VERSION), headers, F.lit(END), block).alias("record"))


def write(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> str:
    """Write the archive files into ``path`` (by default a new folder in the shared one); returns the path."""
    path = path or shared_path(pages.sparkSession, "llm", f"warc-{uuid.uuid4().hex}")
    records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


CANDIDATE = "file string, split long, at long, size long, head long, length long, type string, page_id long, refers_to long, digest string, stated string"


def candidates(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """(file, split, at, size, head, length, type, page_id, refers_to, digest, stated) of every text behind a magic, in one scan.

    ``at``: offset in the split's own text; ``size``: bytes up to the next magic; ``head``: bytes up to the block;
    ``digest``: of the block, if all of it is there; ``stated``: the payload's by the header.  With ``blocks`` also the text itself."""
    lines = spark.read.option("lineSep", VERSION).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"))
    end, magic = END.encode(), len(VERSION)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in names.split(",")])
        here, at = None, 0
        for b in batches:
            out = []
            for value, file, split in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (file, split) != here:
                    here, at = (file, split), 0
                row = {"file": file, "split": split, "at": at, "size": len(value)}
                cut = value.find(end)
                fields = dict(line.split(b": ", 1) for line in value[:max(cut, 0)].split(b"\r\n") if b": " in line)
                length = fields.get(b"Content-Length", b"")
                if length.isdigit() and len(length) < 19 and b"WARC-Type" in fields:
                    head, n = cut + len(end), int(length)
                    row |= {"head": head, "length": n, "type": fields[b"WARC-Type"].decode("ascii", "replace"),
                            "page_id": _number(fields.get(b"Page-ID")),
                            "refers_to": _number(fields.get(b"WARC-Refers-To-Page")),
                            "stated": fields.get(b"WARC-Payload-Digest", b"").decode("ascii", "replace").removeprefix("sha1:")}
                    if head + n <= len(value):
                        row["digest"] = base32_sha1(value[head: head + n])
                if blocks:
                    row["block"] = value
                out.append(row)
                at += len(value) + magic
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = CANDIDATE + ", block binary" * blocks
    return lines.mapInArrow(rows, names)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _number(field: bytes | None) -> int | None:
    try:
        return int(field) if field else None
    except ValueError:
        return None


def chained(found: DataFrame) -> DataFrame:
    """``found`` with ``start`` (offset in the file, behind the magic) and ``next`` (the successor's start)."""
    magic = len(VERSION)
    splits = found.groupBy("file", "split").agg(F.sum(F.col("size") + magic).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split of a file; files have a bounded number of records.
    placed = splits.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    out = found.join(placed, ["file", "split"]).withColumn("start", F.col("base") + F.col("at"))
    return out.withColumn("next", F.col("start") + F.col("head") + F.col("length") + len(END) + magic)


def reachable(links: DataFrame) -> DataFrame:
    """(file, start) reachable from each file's first record; ``links``: (file, start, next).

    Pointer jumping: after round k every pointer spans 2**k records and all
    records nearer than that are marked."""
    starts = links.select("file", F.col("start").alias("next"))
    jump = stored(links.join(starts, ["file", "next"], "left_semi").select("file", "start", "next"), "warc-jump")
    marked = stored(links.where(F.col("start") == len(VERSION)).select("file", "start"), "warc-marked")
    while True:
        reached = marked.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        marked = stored(marked.unionByName(reached).distinct(), "warc-marked")
        ahead = jump.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(ahead, ["file", "next"]).select("file", "start", F.col("far").alias("next")), "warc-jump")
        if jump.isEmpty():
            # No pointer of this length is left, so everything reachable is marked.
            return marked


def records_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The true records (file, start, head, length, type, page_id, refers_to, digest, stated), and the pieces
    (file, start, owner) of those whose block holds a magic."""
    narrow = stored(chained(stored(candidates(spark, path), "warc-candidates")), "warc-chained")
    found = narrow.where(F.col("length").isNotNull())
    true_records = stored(
        found.join(reachable(found.select("file", "start", "next")), ["file", "start"], "left_semi")
        .select("file", "start", "head", "length", "type", "page_id", "refers_to", "digest", "stated"), "warc-records")
    # Candidates between a record and its successor are pieces of its block; what is behind it is cut off by its length.
    owner = F.last(F.when(F.col("true"), F.col("start")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    parted = true_records.where(F.col("digest").isNull()).select("file", F.col("start").alias("owner"))
    pieces = (
        narrow.select("file", "start").join(true_records.select("file", "start", F.lit(True).alias("true")), ["file", "start"], "left")
        .select("file", "start", owner.alias("owner")).join(parted, ["file", "owner"], "left_semi").select("file", "start", "owner")
    )
    return true_records, stored(pieces, "warc-pieces")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return chained(candidates(spark, path, blocks=True)).select("file", "start", "block")


def _joined(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, start, block): the pieces of each block with the magic between them put back."""
    return (
        pieces.join(blocks, ["file", "start"]).groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("start", "block"))).alias("parts"))
        .select("file", F.col("owner").alias("start"), F.aggregate(
            F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["block"],
            lambda acc, p: F.concat(acc, F.lit(VERSION).cast("binary"), p["block"])).alias("block"))
    )


def _payload() -> Column:
    return F.substring("block", F.col("head").cast("int") + 1, F.col("length").cast("int"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload) of every true record of the archives; a revisit has an empty one."""
    true_records, pieces = records_of(spark, path)
    blocks = _blocks(spark, path)
    whole = true_records.where(F.col("digest").isNotNull()).join(blocks, ["file", "start"])
    parted = true_records.where(F.col("digest").isNull()).join(_joined(pieces, blocks), ["file", "start"])
    return whole.unionByName(parted).select("page_id", F.col("type").alias("record_type"), "refers_to", _payload().alias("payload"))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a revisit has its response's payload.

    Digests come from the scan that finds the candidates; only blocks that hold a magic are read again."""
    true_records, pieces = records_of(spark, path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = true_records.where(F.col("digest").isNotNull()).select(
        "page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to", "stated")
    if not pieces.isEmpty():
        again = true_records.where(F.col("digest").isNull()).join(_joined(pieces, _blocks(spark, path)), ["file", "start"])

        def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["payload_digest"] = [base32_sha1(p) for p in b["payload"]]
                yield b.drop(columns="payload")

        rows = rows.unionByName(
            again.select("page_id", F.col("length").alias("payload_bytes"), F.col("type").alias("record_type"), "refers_to", "stated",
                         _payload().alias("payload"))
            .mapInPandas(digests, "page_id long, payload_bytes long, record_type string, refers_to long, stated string, payload_digest string")
            .select(*columns, "stated"))
    rows = stored(rows, "warc-digests")
    # Pages of one id may differ: a revisit's response has the id that it names and the digest that it states.
    named = ["refers_to", "payload_digest"]
    responses = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.first("payload_bytes").alias("payload_bytes"))
    revisits = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("stated").alias("payload_digest"))
    # Only responses that a revisit names, so that a hot one meets its revisits in a join that can be split.
    return rows.where("record_type <> 'revisit'").select(columns).unionByName(
        revisits.join(responses, named, "left").select(columns))
