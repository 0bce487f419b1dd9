"""Queries for projections, normalisation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions import headers as H
from tabvet.functions import semantics as S
from tabvet.operators import normalize as NZ
from tabvet.queries.registry import register
from tabvet.sources.derived import DELTA_SQL, delta_items
from tabvet.sources.tables import header_cells, load, stg_b, stg_e, stg_m, with_staging


def _in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ------------------------------------------------------------------ P1 / P2
_CANON_CASE = " ".join(
    f"WHEN key IN ({_in_list(names)}) THEN '{canon}'" for canon, names in FV.HEADER_ALIASES.items()
)
_ID_SQL = "(key LIKE '%아이디%' OR regexp_matches(base, '(?i)(^|[^0-9A-Za-z])id($|[^0-9A-Za-z])'))"


@register(
    "canonical_headers",
    with_staging("header_cells")
    + f""", b AS (SELECT file_id, pos, raw_header, trim(regexp_replace(raw_header, '\\s+', ' ', 'g')) AS base FROM header_cells),
k AS (SELECT *, lower(regexp_replace(base, '\\s+', '', 'g')) AS key FROM b)
SELECT file_id, pos, raw_header,
  CASE WHEN {_ID_SQL} THEN base {_CANON_CASE} ELSE base END AS canonical_header
FROM k""",
)
def canonical_headers(spark, sf):
    h = header_cells(spark, sf)
    return h.select("file_id", "pos", "raw_header", H.canonical_header("raw_header").alias("canonical_header"))


@register(
    "safe_identifiers",
    with_staging("header_cells")
    + """, b0 AS (
  SELECT file_id, pos, raw_header,
         regexp_replace(regexp_replace(raw_header, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS b FROM header_cells),
b1 AS (SELECT *, CASE WHEN b = '' THEN 'unnamed' WHEN lower(b) = 'source_channel' THEN 'raw_source_channel' ELSE b END AS b1 FROM b0),
b2 AS (SELECT *, CASE WHEN length(b1) > 64 THEN substr(b1, 1, 55) || '_' || substr(sha1(b1), 1, 8) ELSE b1 END AS base FROM b1),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id, lower(base) ORDER BY pos) AS n FROM b2)
SELECT file_id, pos, raw_header,
  CASE WHEN n = 1 THEN base ELSE substr(base, 1, 64 - length('_' || CAST(n AS VARCHAR))) || '_' || CAST(n AS VARCHAR) END AS safe_name
FROM n""",
)
def safe_identifiers(spark, sf):
    return H.safe_identifiers(header_cells(spark, sf), "file_id", "pos", "raw_header")


# ------------------------------------------------------------------ P3 / P4 / P5
@register(
    "merge_alias_columns",
    with_staging("stg_b")
    + """SELECT row_id, COALESCE(NULLIF(ad_group, ''), NULLIF(sessions, ''),
  CASE WHEN ad_group IS NOT NULL OR sessions IS NOT NULL THEN '' END) AS merged FROM stg_b""",
)
def merge_alias_columns(spark, sf):
    return stg_b(spark, sf).select("row_id", NZ.merge_alias_columns("ad_group", "sessions").alias("merged"))


@register(
    "union_sources",
    with_staging("stg_b", "stg_e")
    + """SELECT 'b' AS src, row_id, source_channel, day, cost, ad_group FROM stg_b
UNION ALL BY NAME
SELECT 'e' AS src, row_id, source_channel, day, value, "user" FROM stg_e""",
)
def union_sources(spark, sf):
    b = stg_b(spark, sf).select(F.lit("b").alias("src"), "row_id", "source_channel", "day", "cost", "ad_group")
    e = stg_e(spark, sf).select(F.lit("e").alias("src"), "row_id", "source_channel", "day", "value", "user")
    return NZ.union_sources([b, e])


_HASH_COLS = ["source_channel", "campaign", "day", "ad_group", "device", "cost", "sessions"]


@register(
    "row_hash",
    with_staging("stg_b")
    + f"""SELECT row_id,
  sha256(concat_ws('|', {", ".join(f"COALESCE({c}, '')" for c in _HASH_COLS)})) AS source_row_hash,
  sha256(to_json(map_from_entries(list_sort(map_entries(MAP {{{", ".join(f"'{c}': COALESCE({c}, '')" for c in _HASH_COLS)}}}))))) AS payload_hash
FROM stg_b""",
)
def row_hash(spark, sf):
    df = stg_b(spark, sf)
    payload = F.create_map(*[x for c in _HASH_COLS for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))])
    return df.select("row_id", S.row_hash(_HASH_COLS).alias("source_row_hash"), S.payload_hash(payload).alias("payload_hash"))


# ------------------------------------------------------------------ P6 / P7 / P8 / P9
def _parse_number_sql(x: str) -> str:
    cleaned = f"regexp_replace(trim({x}), '[^0-9.\\-]', '', 'g')"
    return (f"CASE WHEN trim({x}) IS NULL OR trim({x}) = '' OR lower(trim({x})) = 'total' THEN NULL "
            f"WHEN {cleaned} IN ('', '-', '.') THEN NULL ELSE TRY_CAST({cleaned} AS DOUBLE) END")


@register(
    "parse_number",
    with_staging("stg_m")
    + f"SELECT row_id, num_cell, {_parse_number_sql('num_cell')} AS num_value, {_parse_number_sql('clicks_cell')} AS clicks_value FROM stg_m",
)
def parse_number(spark, sf):
    df = stg_m(spark, sf)
    return df.select("row_id", "num_cell", S.parse_number("num_cell").alias("num_value"), S.parse_number("clicks_cell").alias("clicks_value"))


def _parse_date_text_sql(x: str) -> str:
    t = f"trim({x})"
    sep = "(20\\d{2})[-.\\s년]+(\\d{1,2})[-.\\s월]+(\\d{1,2})"
    cmp_ = "(20\\d{2})(\\d{2})(\\d{2})"

    def fmt(p):
        y = f"regexp_extract({t}, '{p}', 1)"
        m = f"regexp_extract({t}, '{p}', 2)"
        d = f"regexp_extract({t}, '{p}', 3)"
        return (f"CASE WHEN {y} <> '' THEN {y} || '-' || lpad(CAST(CAST({m} AS INTEGER) AS VARCHAR), 2, '0') || '-' || "
                f"lpad(CAST(CAST({d} AS INTEGER) AS VARCHAR), 2, '0') END")

    return f"CASE WHEN NOT ({t} IS NULL OR {t} = '' OR lower({t}) = 'total') THEN COALESCE({fmt(sep)}, {fmt(cmp_)}) END"


@register(
    "parse_date",
    with_staging("stg_m")
    + f""", p AS (SELECT row_id, date_cell, {_parse_date_text_sql('date_cell')} AS date_text FROM stg_m)
SELECT row_id, date_cell, date_text, strftime(TRY_STRPTIME(date_text, '%Y-%m-%d'), '%Y-%m-%d') AS date_value FROM p""",
)
def parse_date(spark, sf):
    df = stg_m(spark, sf)
    return df.select(
        "row_id", "date_cell", S.parse_date_text("date_cell").alias("date_text"),
        F.date_format(S.parse_date("date_cell"), "yyyy-MM-dd").alias("date_value"),
    )


def _device_group_sql(x: str) -> str:
    n = f"lower(trim({x}))"
    return (f"CASE WHEN {x} IS NULL THEN NULL "
            f"WHEN {n} IN ({_in_list(FV.DEVICE_MOBILE)}) OR {n} LIKE '%mobile%' THEN 'MO' "
            f"WHEN {n} IN ({_in_list(FV.DEVICE_DESKTOP)}) OR {n} LIKE '%desktop%' THEN 'PC' "
            f"WHEN {' OR '.join(f'{n} LIKE ' + repr('%' + t + '%') for t in FV.DEVICE_TABLET_TOKENS)} THEN 'TABLET' "
            f"ELSE NULLIF(trim({x}), '') END")


@register("device_group", with_staging("stg_m") + f"SELECT row_id, device_cell, {_device_group_sql('device_cell')} AS device_group FROM stg_m")
def device_group(spark, sf):
    df = stg_m(spark, sf)
    return df.select("row_id", "device_cell", S.device_group("device_cell").alias("device_group"))


_EXTRA_CONVERSION = ("signup",)
_CONV_SQL = " OR ".join(
    [f"lower(event_type) LIKE '%{t}%'" for t in FV.CONVERSION_TOKENS_LOWER]
    + [f"event_type LIKE '%{t}%'" for t in (*FV.CONVERSION_TOKENS_RAW, *_EXTRA_CONVERSION)]
)


@register(
    "event_flags",
    f"SELECT event_id, event_type, ({_CONV_SQL}) AS is_conversion, CASE WHEN {_CONV_SQL} THEN 'conversion' ELSE event_type END AS event_category FROM events",
)
def event_flags(spark, sf):
    e = load(spark, sf, "events")
    return e.select(
        "event_id", "event_type",
        S.is_conversion("event_type", _EXTRA_CONVERSION).alias("is_conversion"),
        S.event_category("event_type", _EXTRA_CONVERSION).alias("event_category"),
    )


# ------------------------------------------------------------------ P10 / P11 / P12 / P13
PAYLOAD_HEADERS = {"일자": "date_cell", "보고 시작": "start_cell", "캠페인": "campaign", "캠페인 이름": "session_campaign",
                   "노출": "num_cell", "노출수": "clicks_cell", "기기": "device_cell"}


def _first_sql(*cols: str) -> str:
    return "COALESCE(" + ", ".join(f"NULLIF(trim({c}), '')" for c in cols) + ")"


@register(
    "canonical_payload",
    with_staging("stg_m")
    + f""", c AS (SELECT row_id, {_first_sql('date_cell')} AS report_date, {_first_sql('start_cell')} AS report_start_date,
  {_first_sql('campaign', 'session_campaign')} AS campaign_name, {_first_sql('num_cell', 'clicks_cell')} AS impressions,
  {_first_sql('device_cell')} AS device_raw FROM stg_m)
SELECT row_id, report_date, campaign_name, impressions, device_raw,
  strftime(TRY_STRPTIME({_parse_date_text_sql('COALESCE(report_date, report_start_date)')}, '%Y-%m-%d'), '%Y-%m-%d') AS report_date_parsed
FROM c""",
)
def canonical_payload(spark, sf):
    df = stg_m(spark, sf)
    m = NZ.payload_map(df, PAYLOAD_HEADERS)
    fields = NZ.canonical_payload_columns(m, FV.SOURCE_FIELD_CODES)
    out = df.select("row_id", *[c.alias(k) for k, c in fields.items()])
    return out.select(
        "row_id", "report_date", "campaign_name", "impressions", "device_raw",
        NZ.canonical_report_date(F.col("report_date"), F.col("report_start_date")).alias("report_date_parsed"),
    )


_CANON_DEV = "lower(COALESCE(NULLIF(device_cell, ''), ''))"


@register(
    "canonical_rows",
    with_staging("stg_m")
    + f"""SELECT row_id AS source_row_id, source_channel,
  strftime(CASE WHEN regexp_matches(NULLIF(date_cell, ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_STRPTIME(date_cell, '%Y-%m-%d')
       WHEN regexp_matches(NULLIF(date_cell, ''), '^[0-9]{{4}}\\.\\s*[0-9]{{1,2}}\\.\\s*[0-9]{{1,2}}\\.?$')
         THEN TRY_STRPTIME(trim(regexp_replace(date_cell, '\\s+', '', 'g'), '.'), '%Y.%m.%d') END, '%Y-%m-%d') AS report_date,
  CASE WHEN {_CANON_DEV} IN ({_in_list(FV.CANON_DEVICE_MOBILE)}) THEN 'mobile'
       WHEN {_CANON_DEV} IN ({_in_list(FV.CANON_DEVICE_DESKTOP)}) THEN 'desktop'
       WHEN {_CANON_DEV} IN ({_in_list(FV.CANON_DEVICE_TABLET)}) THEN 'tablet'
       ELSE NULLIF(device_cell, '') END AS device_type_std,
  NULLIF(COALESCE(NULLIF(campaign, ''), NULLIF(session_campaign, '')), '') AS campaign_name,
  NULLIF(COALESCE(NULLIF(creative, ''), NULLIF(ad_content, '')), '') AS creative_name,
  CAST(TRY_CAST(NULLIF(REPLACE(num_cell, ',', ''), '') AS DECIMAL(18,2)) AS DOUBLE) AS impressions,
  CAST(TRY_CAST(NULLIF(REPLACE(clicks_cell, ',', ''), '') AS DECIMAL(18,2)) AS DOUBLE) AS clicks
FROM stg_m""",
)
def canonical_rows(spark, sf):
    df = stg_m(spark, sf)
    rows = NZ.canonical_rows(df, {
        "report_date": "date_cell", "device": "device_cell", "campaign_name": ["campaign", "session_campaign"],
        "creative_name": ["creative", "ad_content"], "impressions": "num_cell", "clicks": "clicks_cell",
    })
    return rows.select(
        "source_row_id", "source_channel", F.date_format("report_date", "yyyy-MM-dd").alias("report_date"),
        "device_type_std", "campaign_name", "creative_name",
        F.col("impressions").cast("double").alias("impressions"), F.col("clicks").cast("double").alias("clicks"),
    )


EXTRA_HEADERS = {"일자": "date_cell", "보고 시작": "start_cell", "캠페인": "campaign", "노출": "num_cell",
                 "비고1": "ad_content", "비고2": "creative", "비고3": "device_cell"}
CONSUMED = ["일자", "보고 시작", "캠페인", "노출"]


@register(
    "additional_metrics",
    with_staging("stg_m")
    + "\nUNION ALL ".join(
        f"SELECT row_id, '{h}' AS key, {c} AS value FROM stg_m WHERE trim({c}) <> ''"
        for h, c in EXTRA_HEADERS.items() if h not in CONSUMED
    ),
)
def additional_metrics(spark, sf):
    df = stg_m(spark, sf)
    extra = NZ.additional_metrics(NZ.payload_map(df, EXTRA_HEADERS), CONSUMED)
    return df.select("row_id", F.explode(extra).alias("key", "value"))


@register(
    "flatten_nested",
    """SELECT event_id AS "event.id", event_type AS "event.type", CAST(props->>'k' AS BIGINT) AS "props.k",
  user_id AS "who.user.id", value FROM events""",
)
def flatten_nested(spark, sf):
    e = load(spark, sf, "events")
    nested = e.select(
        F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")).alias("event"),
        F.from_json("props", "k BIGINT").alias("props"),
        F.struct(F.struct(F.col("user_id").alias("id")).alias("user")).alias("who"),
        "value",
    )
    return NZ.flatten_structs(nested)


@register(
    "flatten_deltas",
    "WITH " + DELTA_SQL + """
SELECT delta_item_id, step_key, max(old_value) FILTER (WHERE column_name = 'cost') AS "before.cost",
  max(old_value) FILTER (WHERE column_name = 'sessions') AS "before.sessions",
  max(new_value) FILTER (WHERE column_name = 'cost') AS "after.cost", max(new_value) FILTER (WHERE column_name = 'sessions') AS "after.sessions"
FROM delta GROUP BY delta_item_id, step_key""",
)
def flatten_deltas(spark, sf):
    """P13 on the before and after maps of the delta log."""
    return NZ.flatten_structs(delta_items(spark, sf).select("delta_item_id", "step_key", "before", "after"))


# ------------------------------------------------------------------ P14..P19
@register(
    "normalize_term",
    """SELECT conv_id, turn, lower(regexp_replace(nfc_normalize(text), '\\s+', '', 'g')) AS normalized,
  CAST(length(lower(regexp_replace(nfc_normalize(text), '\\s+', '', 'g'))) AS INTEGER) AS full_length FROM conversations""",
)
def normalize_term(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", S.normalize_term("text").alias("normalized"),
        F.length(S.normalize_term("text")).alias("full_length"),
    )


def _role_sql(x: str) -> str:
    parts = []
    for role, toks in FV.SEMANTIC_ROLE_TOKENS:
        parts.append(f"WHEN {' OR '.join(f'{x} LIKE ' + repr('%' + t + '%') for t in toks)} THEN '{role}'")
    return "CASE " + " ".join(parts) + " END"


@register(
    "semantic_role",
    with_staging("header_cells")
    + f""", k AS (SELECT file_id, pos, raw_header,
   lower(regexp_replace(nfc_normalize(raw_header), '\\s+', '', 'g')) AS nk FROM header_cells)
SELECT file_id, pos, raw_header, {_role_sql('nk')} AS semantic_role FROM k""",
)
def semantic_role(spark, sf):
    h = header_cells(spark, sf)
    return h.select("file_id", "pos", "raw_header", S.semantic_role("raw_header").alias("semantic_role"))


@register(
    "dim_date_attrs",
    with_staging("stg_b")
    + """, d AS (SELECT DISTINCT day, CAST(day AS DATE) AS d FROM stg_b WHERE day IS NOT NULL)
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, day AS date_value, CAST(year(d) AS INTEGER) AS year_no,
  CAST(month(d) AS INTEGER) AS month_no, strftime(d, '%G-W%V') AS week_label, CAST(isodow(d) AS INTEGER) AS weekday_no,
  strftime(d, '%A') AS weekday_name FROM d
UNION ALL SELECT 0, '1000-01-01', NULL, NULL, 'unknown', NULL, 'unknown'""",
)
def dim_date_attrs(spark, sf):
    return NZ.dim_date_attrs(stg_b(spark, sf), "day")


@register(
    "drop_empty_columns",
    with_staging("stg_b") + "SELECT row_id, source_channel, campaign, day, ad_group, device, cost, sessions, '' AS row_count FROM stg_b",
)
def drop_empty_columns(spark, sf):
    df = stg_b(spark, sf).withColumns({
        "empty_note": F.lit(""), "blank_note": F.lit(None).cast("string"),
        "source_row_hash": S.row_hash(["row_id"]), "row_count": F.lit(""),
    })
    return NZ.drop_empty_columns(df)


@register(
    "request_fingerprint",
    "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS fingerprint FROM conversations",
)
def request_fingerprint(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", S.fingerprint("text").alias("fingerprint"))


@register("mask_sample_columns", with_staging("stg_b") + "SELECT row_id, campaign, cost FROM stg_b ORDER BY row_id LIMIT 3")
def mask_sample_columns(spark, sf):
    return NZ.mask_sample(stg_b(spark, sf), ["row_id", "campaign", "cost", "not_a_column"], ["row_id"], 3)
