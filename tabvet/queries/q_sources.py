"""Queries for file sources (S1-S7, S10, I5) over export files that Spark
writes from the driver tables into the shared folder."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions import headers as H
from tabvet.queries.registry import register
from tabvet.session import shared_path
from tabvet.operators.catalog import distinct_channels
from tabvet.sources import files as FS
from tabvet.sources.tables import TABLES, header_cells, load, stg_b, with_staging

CSV_COLS = ["row_id", "campaign", "day", "ad_group", "cost"]
BOOK_TITLE = "캠페인 성과 리포트"
BOOK_HEADERS = ["번호", "캠페인", "날짜", "광고 그룹", "비용"]
# fixed dialects of the synthetic export folders: folder -> (channels, encoding, separator)
EXPORTS = {
    "DA_display": (("1-URGENT", "2-HIGH"), "UTF-8", ","),
    "SA_search": (("3-MEDIUM",), "UTF-16", ";"),
    "GA_web": (("4-NOT SPECIFIED", "5-LOW"), "UTF-8", "\t"),
}
_LISTED = [c for channels, _, _ in EXPORTS.values() for c in channels]
#: Channels that no folder lists, and rows without one, go to a folder of their own.
FOLDERS = {**EXPORTS, "other": ((), "UTF-8", "|")}
#: Row ids of an exported file: the number of files grows with the rows.
FILE_IDS = 4_096


def _exported(spark, sf):
    return stg_b(spark, sf).select(*[F.col(c).cast("string") for c in CSV_COLS], "source_channel", F.col("row_id").alias("id"),
                                   F.floor(F.col("row_id") / FILE_IDS).alias("export"))


def _write_csvs(b, root: str) -> None:
    """One file per folder and range of ids, rows by id."""
    for folder, (channels, enc, sep) in FOLDERS.items():
        own = F.col("source_channel").isin(*channels) if channels else ~F.coalesce(F.col("source_channel").isin(*_LISTED), F.lit(False))
        part = b.where(own).repartition("export").sortWithinPartitions("export", "id").select(*CSV_COLS, "export")
        (part.write.partitionBy("export").option("header", True).option("sep", sep).option("encoding", enc)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{root}/{folder}"))


def _write_workbooks(b, target: str) -> None:
    """One workbook per range of ids: two title rows and the header above the data
    on sheet 'data' (shared strings), the channel list on sheet 'meta' (inline)."""
    # the store that Spark resolves the folder in, so that all tasks write to the same one
    jvm, conf = b.sparkSession._jvm, b.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.hadoop.fs.Path(target)
    uri = folder.getFileSystem(conf).makeQualified(folder).toString()
    uri = uri if "://" in uri else uri.replace(":", "://", 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        import pyarrow.fs as pafs

        rows = [[BOOK_TITLE, ""], ["", ""], BOOK_HEADERS] + pdf.sort_values("id")[CSV_COLS].fillna("").astype(str).values.tolist()
        meta = [["source_channel"]] + [[c] for c in sorted(pdf["source_channel"].dropna().unique())]
        name = f"export={pdf['export'].iloc[0]}/book.xlsx"
        buf = io.BytesIO()  # built in memory, streamed to the shared folder (no local temp files)
        FS.write_workbook(buf, {"data": rows, "meta": meta})
        fs, p = pafs.FileSystem.from_uri(uri)
        fs.create_dir(f"{p}/{name}".rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{p}/{name}") as dst:
            dst.write(buf.getvalue())
        return pd.DataFrame({"written": [f"{target}/{name}"]})

    b.groupBy("export").applyInPandas(run, "written string").count()


def _files(spark, sf, csvs: bool = True, books: bool = True):
    """The listed files of an export with the kinds that a query reads."""
    root = shared_path(spark, "files", uuid.uuid4().hex)
    b = _exported(spark, sf)
    if csvs:
        _write_csvs(b, root)
    if books:
        _write_workbooks(b, f"{root}/DA_workbooks")
    return FS.discover_files(spark, root)


def _read(files):
    profiles = FS.sniff_csv_dialect(files)
    return profiles, FS.read_workbooks(files).unionByName(FS.read_delimited(profiles))


def _sql_list(texts) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


_FOLDER_SQL = "CASE " + " ".join(f"WHEN source_channel IN ({_sql_list(ch)[1:-1]}) THEN '{f}'" for f, (ch, _, _) in EXPORTS.items()) + " ELSE 'other' END"
_EXPORT_SQL = with_staging("stg_b") + f""", x AS (SELECT row_id, campaign, day, ad_group, cost, source_channel, row_id // {FILE_IDS} AS export,
  {_FOLDER_SQL} AS folder FROM stg_b)"""
_DIALECT_SQL = ", ".join(f"('{f}', '{'utf-16' if enc == 'UTF-16' else FV.CSV_ENCODINGS[0]}', {'chr(9)' if sep == chr(9) else repr(sep)})"
                         for f, (_, enc, sep) in FOLDERS.items())
# The rows of every table as its file holds them.
_TABLES_SQL = _EXPORT_SQL + f""", cells AS (
  SELECT *, list_transform([CAST(row_id AS VARCHAR), campaign, day, ad_group, cost], lambda c: COALESCE(c, '')) AS texts FROM x),
data AS (
  SELECT export, 'book' AS folder, 'data' AS sheet, 3 + row_number() OVER (PARTITION BY export ORDER BY row_id) AS row_no,
    list_transform(texts, lambda c: trim(c)) AS texts FROM cells
  UNION ALL SELECT DISTINCT export, 'book', 'data', unnest([1, 2, 3]), unnest([['{BOOK_TITLE}'], CAST([] AS VARCHAR[]), {_sql_list(BOOK_HEADERS)}]) FROM x
  UNION ALL SELECT DISTINCT export, 'book', 'meta', 1, ['source_channel'] FROM x
  UNION ALL SELECT export, 'book', 'meta', 1 + row_number() OVER (PARTITION BY export ORDER BY source_channel), [source_channel]
    FROM (SELECT DISTINCT export, source_channel FROM x WHERE source_channel IS NOT NULL)
  UNION ALL SELECT export, folder, NULL, 1 + row_number() OVER (PARTITION BY export, folder ORDER BY row_id), texts FROM cells
  UNION ALL SELECT DISTINCT export, folder, NULL, 1, {_sql_list(CSV_COLS)} FROM x)
"""
_HEADERS_SQL = _TABLES_SQL + f""", filled AS (SELECT *, list_filter(list_transform(texts, lambda c: trim(c)), lambda c: c <> '') AS own FROM data WHERE row_no <= {FV.HEADER_SEARCH_ROWS}),
signals AS (SELECT *, len(own) AS width, COALESCE(list_sum(list_transform(own, lambda c: CASE WHEN list_contains({_sql_list(FV.HEADER_TOKENS)}, c) THEN 2
    WHEN len(list_filter({_sql_list(FV.HEADER_TOKENS)}, lambda t: contains(c, t))) > 0 THEN 1 ELSE 0 END)), 0) AS signal FROM filled),
best AS (SELECT *, row_number() OVER (PARTITION BY export, folder, sheet ORDER BY width >= 2 DESC, signal > 0 DESC, signal DESC, width DESC, row_no) AS k FROM signals),
headers AS (SELECT export, folder, sheet, CASE WHEN width >= 2 THEN CAST(row_no AS BIGINT) END AS header_row_no FROM best WHERE k = 1),
dialects(folder, encoding, delimiter) AS (VALUES {_DIALECT_SQL})
"""


def _folder():
    return F.regexp_extract("path", r"/([^/]+)/export=[^/]+/[^/]+$", 1).alias("folder")


def _export():
    return F.regexp_extract("path", r"/export=([^/]+)/[^/]+$", 1).cast("long").alias("export")


@register(
    "discover_files",
    _EXPORT_SQL + f""", sized AS (
  SELECT folder, export, sum(length(CAST(row_id AS VARCHAR)) + 5 + list_sum(list_transform([campaign, day, ad_group, cost],
    lambda c: CASE WHEN c IS NULL THEN 0 WHEN c = '' THEN 2 ELSE length(c) END))) + {len(",".join(CSV_COLS)) + 1} AS chars FROM x GROUP BY folder, export)
SELECT folder || '/export=' || export AS directory, 'csv' AS extension, CAST(CASE WHEN folder IN ({", ".join(
    f"'{f}'" for f, (_, enc, _) in FOLDERS.items() if enc == "UTF-16")}) THEN 2 + 2 * chars ELSE chars END AS BIGINT) AS n_bytes FROM sized
UNION ALL SELECT DISTINCT 'DA_workbooks/export=' || export, 'xlsx', NULL FROM x""",
)
def discover_files(spark, sf):
    """The exported files; packed workbooks have no size that is known beforehand."""
    files = _files(spark, sf)
    extension = F.regexp_extract("relative_path", r"([^.]+)$", 1)
    return files.select(F.regexp_extract("relative_path", r"^(.*)/[^/]+$", 1).alias("directory"), extension.alias("extension"),
                        F.when(extension == "csv", F.col("length")).alias("n_bytes"))


@register(
    "sniff_csv_dialect",
    _HEADERS_SQL + "SELECT folder, export, encoding, delimiter, TRUE AS clean FROM (SELECT DISTINCT folder, export FROM x) JOIN dialects USING (folder)",
)
def sniff_csv_dialect(spark, sf):
    prof = FS.sniff_csv_dialect(_files(spark, sf, books=False))
    return prof.select(_folder(), _export(), "encoding", "delimiter", "clean")


@register(
    "read_delimited",
    with_staging("stg_b") + "SELECT CAST(row_id AS VARCHAR) AS row_id, campaign, COALESCE(day, '') AS day, "
    "COALESCE(ad_group, '') AS ad_group, cost FROM stg_b",
)
def read_delimited(spark, sf):
    rows = FS.read_delimited(FS.sniff_csv_dialect(_files(spark, sf, books=False)))
    data = rows.where(F.col("row_no") > 1)  # one header line per written file
    return data.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(CSV_COLS)])


@register(
    "read_workbooks",
    _TABLES_SQL + "SELECT export, sheet, CAST(row_no AS BIGINT) AS row_no, array_to_string(texts, '|') AS cells FROM data WHERE folder = 'book'",
)
def read_workbooks(spark, sf):
    rows = FS.read_workbooks(_files(spark, sf, csvs=False))
    return rows.select(_export(), "sheet", "row_no", F.array_join("cells", "|").alias("cells"))


@register("detect_header_row", _HEADERS_SQL + "SELECT export, sheet, header_row_no FROM headers")
def detect_header_row(spark, sf):
    _, rows = _read(_files(spark, sf))
    return FS.detect_header_row(rows).select(_export(), "sheet", "header_row_no")


@register(
    "schema_profiles",
    _HEADERS_SQL + """SELECT export, sheet, CASE WHEN folder = 'book' THEN 'xlsx' ELSE 'csv' END AS file_format, encoding, delimiter, header_row_no,
  header_row_no > 1 AS has_metadata_rows FROM headers LEFT JOIN dialects USING (folder) WHERE header_row_no IS NOT NULL""",
)
def schema_profiles(spark, sf):
    files = _files(spark, sf)
    prof, rows = _read(files)
    out = FS.schema_profiles(files, prof, FS.detect_header_row(rows))
    return out.select(_export(), "sheet", "file_format", "encoding", "delimiter", "header_row_no", "has_metadata_rows")


_NAMES_SQL = (
    with_staging("header_cells")
    + """, b AS (SELECT file_id, pos, CASE WHEN regexp_replace(raw_header, '^\\s+|\\s+$', '', 'g') = '' THEN 'unnamed_' || CAST(pos AS VARCHAR)
              ELSE regexp_replace(raw_header, '^\\s+|\\s+$', '', 'g') END AS base FROM header_cells),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id, base ORDER BY pos) AS n FROM b),
named AS (SELECT file_id, pos, CASE WHEN n = 1 THEN base ELSE base || '_' || CAST(n AS VARCHAR) END AS header FROM n)
""")


@register("header_names", _NAMES_SQL + "SELECT * FROM named")
def header_names(spark, sf):
    return H.unique_headers(header_cells(spark, sf), "file_id", "pos", "raw_header").select("file_id", "pos", "header")


@register(
    "header_names_extra",
    _NAMES_SQL + """, ends AS (SELECT file_id, max(pos) AS last FROM named GROUP BY file_id)
SELECT * FROM named UNION ALL SELECT file_id, k, 'extra_' || k FROM (SELECT file_id, CAST(unnest(range(last + 1, last + 1 + file_id % 3)) AS INTEGER) AS k FROM ends)""",
)
def header_names_extra(spark, sf):
    """S6 over whole header rows, with names for the cells of wider data rows."""
    rows = header_cells(spark, sf).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "raw_header"))).alias("header"))
    texts = F.transform("header", lambda h: h["raw_header"])
    named = rows.select("file_id", F.posexplode(FS.header_names(texts, F.size(texts) + (F.col("file_id") % 3).cast("int"))).alias("at", "header"))
    return named.select("file_id", (F.col("at") + 1).alias("pos"), "header")


_PAYLOAD_HEADERS = ["캠페인", "날짜", "광고 그룹", "디바이스", "비용"]


@register(
    "rows_to_payload",
    with_staging("stg_b")
    + """, r AS (SELECT row_id, campaign AS c1, day AS c2, COALESCE(ad_group, '') AS c3, device AS c4, cost AS c5,
                CASE WHEN row_id % 9 = 0 THEN ' extra ' END AS c6 FROM stg_b WHERE row_id % 37 <> 0)
"""
    + "\nUNION ALL ".join(
        f"SELECT row_id, '{h}' AS key, regexp_replace(c{i + 1}, '^\\s+|\\s+$', '', 'g') AS value FROM r"
        for i, h in enumerate(_PAYLOAD_HEADERS))
    + "\nUNION ALL SELECT row_id, 'extra_6', 'extra' FROM r WHERE c6 IS NOT NULL",
)
def rows_to_payload(spark, sf):
    b = stg_b(spark, sf)
    k = F.col("row_id")
    cells = F.array(F.col("campaign"), F.col("day"), F.coalesce("ad_group", F.lit("")), F.col("device"), F.col("cost"))
    cells = F.when(k % 37 == 0, F.array(*[F.lit(" ")] * 5)).when(k % 9 == 0, F.array_append(cells, F.lit(" extra "))).otherwise(cells)
    rows = b.select(F.lit("stg_b").alias("path"), F.lit(None).cast("string").alias("sheet"), (k + 2).alias("row_no"), cells.alias("cells"))
    headers = b.sparkSession.createDataFrame([("stg_b", None, 1, _PAYLOAD_HEADERS)],
                                             "path string, sheet string, header_row_no long, headers array<string>")
    p = FS.rows_to_payload(rows, headers)
    return p.select((F.col("row_no") - 2).alias("row_id"), F.explode("payload").alias("key", "value"))


_SPARK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz",
                "FLOAT[]": "array<float>"}


#: Column that holds the channel, for the tables that have one.
CHANNEL_COLUMN = {"documents": "source"}


def _channels_sql(table: str) -> str:
    c = CHANNEL_COLUMN.get(table)
    return f"array_to_string(list_sort(list(DISTINCT {c}) FILTER (trim({c}) <> '')), ',')" if c else "CAST(NULL AS VARCHAR)"


@register(
    "read_tables",
    "WITH read AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {_channels_sql(t)} AS channels FROM {t}" for t in TABLES)
    + ") SELECT table_name, CAST(ordinal_position AS BIGINT) AS ordinal, column_name, CASE data_type "
    + " ".join(f"WHEN '{d}' THEN '{s}'" for d, s in _SPARK_TYPES.items())
    + " ELSE lower(data_type) END AS data_type, row_count, channels FROM information_schema.columns JOIN read USING (table_name)",
)
def read_tables(spark, sf):
    """Every table read in full: its live schema, its rows, and its sorted channel list."""
    schema, read = [], None
    for t in TABLES:
        df = load(spark, sf, t)
        schema += [(t, i + 1, c, d) for i, (c, d) in enumerate(df.dtypes)]
        own = df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        if t in CHANNEL_COLUMN:
            listed = distinct_channels(df, CHANNEL_COLUMN[t]).agg(
                F.array_join(F.array_sort(F.collect_list(CHANNEL_COLUMN[t])), ",").alias("channels"), F.lit(t).alias("table_name"))
            own = own.join(listed, "table_name")
        else:
            own = own.withColumn("channels", F.lit(None).cast("string"))
        read = own if read is None else read.unionByName(own)
    columns = spark.createDataFrame(schema, "table_name string, ordinal long, column_name string, data_type string")
    return columns.join(read, "table_name").select("table_name", "ordinal", "column_name", "data_type", "row_count", "channels")
