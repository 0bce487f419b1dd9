"""Queries for the ingest layers (I1-I7, U1, W4, J4) and path routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.operators import ingest as IG
from tabvet.operators import joins as J
from tabvet.queries.q_projections import _device_group_sql, _parse_date_text_sql, _parse_number_sql
from tabvet.queries.registry import register
from tabvet.session import materialize
from tabvet.sources.derived import IMPORT_HEADERS, IMPORT_SQL, import_rows
from tabvet.sources.tables import load


def _meta_rows(spark, sf):
    r = import_rows(spark, sf)
    return r.withColumn("meta", IG.source_metadata(F.col("file_path"))).select("*", "meta.source_name", "meta.fact_target")


def _bronze(spark, sf):
    return IG.bronze(_meta_rows(spark, sf))


def _silver(spark, sf):
    # bronze is a layer boundary: materialised once, read by both silver facts
    parsed = materialize(_bronze(spark, sf).where(F.col("parse_status") == "parsed"), "bronze_parsed")
    ad = IG.silver_ad_fact(parsed.where(F.col("fact_target") == "fact_ad_daily"))
    ga = IG.silver_ga_fact(parsed.where(F.col("fact_target") == "fact_ga_daily"))
    return ad, ga


def _nz(c: str) -> str:
    return f"NULLIF(trim({c}), '')"


def _hash_sql(*parts: str) -> str:
    return "sha256(to_json([" + ", ".join(parts) + "]))"


def _key_sql(kind: str, name: str, code: str, fall_back: bool = False) -> str:
    name, code = _nz(name), _nz(code) if code != "NULL" else "NULL"
    label = f"COALESCE({name}, {code})" if fall_back else name
    return f"CASE WHEN {name} IS NOT NULL OR {code} IS NOT NULL THEN {_hash_sql(repr(kind), 'source_name', label, code)} END"


def _own_key_sql(kind: str, value: str) -> str:
    return f"CASE WHEN {_nz(value)} IS NOT NULL THEN {_hash_sql(repr(kind), _nz(value))} END"


_DATE_KEY_SQL = "COALESCE(replace(report_date, '-', ''), '0')"
_CELL = {h: f"({sql})" for h, sql in IMPORT_HEADERS.items()}
CAMPAIGN_ID, AD_GROUP, AD_GROUP_ID, CREATIVE_ID, EVENT = (
    _CELL[h] for h in ("캠페인 ID", "광고그룹", "광고 그룹 ID", "광고 소재 ID", "이벤트 이름"))

BASE_SQL = "WITH " + IMPORT_SQL + f""",
meta AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\\.[^.]*$', ''), '_\\d{{4,8}}$', '') AS source_name,
           regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS folder FROM import_rows),
bronze AS (SELECT *, sha256(to_json(map_from_entries(list_sort(map_entries(payload))))) AS payload_hash,
    strftime(TRY_STRPTIME({_parse_date_text_sql(f"COALESCE({_nz('date_cell')}, {_nz('start_cell')})")}, '%Y-%m-%d'), '%Y-%m-%d') AS report_date
  FROM meta),
bronze2 AS (SELECT *, CASE WHEN report_date IS NOT NULL THEN 'parsed' ELSE 'bronze_only' END AS parse_status,
    CASE WHEN report_date IS NULL THEN 'missing_report_date' END AS reason FROM bronze),
ad AS (SELECT row_id, report_date, source_name, {_hash_sql("'media'", 'source_name')} AS media_key, {_DATE_KEY_SQL} AS date_key,
    {_key_sql('campaign', 'campaign', CAMPAIGN_ID, True)} AS campaign_key,
    {_key_sql('ad_group', AD_GROUP, AD_GROUP_ID)} AS ad_group_key,
    {_key_sql('creative', 'creative', CREATIVE_ID)} AS creative_key,
    {_own_key_sql('device', 'device_cell')} AS device_key,
    {_nz('campaign')} AS campaign_name, {_nz(CAMPAIGN_ID)} AS campaign_code, {_nz(AD_GROUP)} AS ad_group_name, {_nz(AD_GROUP_ID)} AS ad_group_code,
    {_nz('creative')} AS creative_name, {_nz(CREATIVE_ID)} AS creative_code, {_nz('device_cell')} AS device_raw,
    COALESCE({_parse_number_sql(_nz('num_cell'))}, 0) AS impressions, COALESCE({_parse_number_sql(_nz('clicks_cell'))}, 0) AS clicks,
    COALESCE({_parse_number_sql(_nz('num_cell'))}, 0) AS cost_raw, 'KRW' AS cost_currency, CAST(NULL AS DOUBLE) AS ctr,
    CAST(CASE WHEN trim(ad_content) <> '' THEN to_json(MAP {{'비고': ad_content}}) ELSE '{{}}' END AS VARCHAR) AS additional_metrics
  FROM bronze2 WHERE parse_status = 'parsed' AND folder NOT LIKE '%GA%'),
ga AS (SELECT row_id, report_date, source_name, {_hash_sql("'media'", 'source_name')} AS media_key, {_DATE_KEY_SQL} AS date_key,
    {_key_sql('campaign', f"COALESCE({_nz('session_campaign')}, {_nz('campaign')})", 'NULL')} AS campaign_key,
    {_key_sql('creative', 'ad_content', 'NULL')} AS creative_key,
    {_own_key_sql('device', 'device_cell')} AS device_key, {_own_key_sql('event', EVENT)} AS event_key,
    COALESCE({_nz('session_campaign')}, {_nz('campaign')}) AS session_campaign,
    {_nz('ad_content')} AS session_content, {_nz('device_cell')} AS device_raw, {_nz(EVENT)} AS event_name,
    COALESCE({_parse_number_sql(_nz('clicks_cell'))}, 0) AS sessions, CAST(0 AS DOUBLE) AS users, CAST(0 AS DOUBLE) AS key_events
  FROM bronze2 WHERE parse_status = 'parsed' AND folder LIKE '%GA%'),
gold AS (
  SELECT report_date, source_name, device_raw, campaign_name, creative_name AS creative_name_raw, impressions, clicks, cost_raw,
         CAST(0 AS DOUBLE) AS sessions, CAST(0 AS DOUBLE) AS users, row_id AS source_ad_fact_id, CAST(NULL AS BIGINT) AS source_ga_fact_id FROM ad
  UNION ALL
  SELECT report_date, source_name, device_raw, session_campaign, CAST(NULL AS VARCHAR), 0, 0, 0, sessions, users, NULL, row_id FROM ga),
gold2 AS (SELECT substr(report_date, 1, 7) AS report_month, *, {_device_group_sql('device_raw')} AS device_group FROM gold)
"""


@register("bronze_raw", BASE_SQL + "SELECT row_id, file_path, payload_hash, report_date, parse_status, reason FROM bronze2")
def bronze_raw(spark, sf):
    return _bronze(spark, sf).select("row_id", "file_path", "payload_hash", "report_date", "parse_status", "reason")


@register(
    "load_stats",
    BASE_SQL + """SELECT file_path, count(*) AS raw_records, count(*) FILTER (WHERE parse_status = 'bronze_only') AS bronze_only_rows,
  count(*) FILTER (WHERE parse_status = 'parsed' AND folder NOT LIKE '%GA%') AS fact_ad_daily,
  count(*) FILTER (WHERE parse_status = 'parsed' AND folder LIKE '%GA%') AS fact_ga_daily,
  count(*) FILTER (WHERE parse_status = 'parsed') AS report_daily_row
FROM bronze2 GROUP BY file_path""",
)
def load_stats(spark, sf):
    return IG.load_stats(_bronze(spark, sf))


@register("silver_ad_fact", BASE_SQL + "SELECT * FROM ad")
def silver_ad_fact(spark, sf):
    return _silver(spark, sf)[0]


@register("silver_ga_fact", BASE_SQL + "SELECT * FROM ga")
def silver_ga_fact(spark, sf):
    return _silver(spark, sf)[1]


@register("gold_union", BASE_SQL + "SELECT * FROM gold")
def gold_union(spark, sf):
    ad, ga = _silver(spark, sf)
    return IG.gold_union(ad, ga).drop("report_month", "device_group")


@register("gold_report_daily", BASE_SQL + "SELECT * FROM gold2")
def gold_report_daily(spark, sf):
    return IG.gold_union(*_silver(spark, sf))


@register(
    "gold_rollup_by_day",
    BASE_SQL + """SELECT report_date, source_name, device_group, count(*) AS row_count, """
    + ", ".join(f"CAST(round(sum(CAST({c} AS DECIMAL(38,6))), 2) AS DOUBLE) AS {c}"
                for c in ("impressions", "clicks", "cost_raw", "sessions", "users"))
    + """
FROM gold2 GROUP BY report_date, source_name, device_group""",
)
def gold_rollup_by_day(spark, sf):
    return IG.gold_rollup(IG.gold_union(*_silver(spark, sf)))


@register(
    "incremental_new_rows",
    BASE_SQL + """SELECT row_id, payload_hash FROM bronze2
WHERE payload_hash NOT IN (SELECT payload_hash FROM bronze2 WHERE row_id % 3 = 0)""",
)
def incremental_new_rows(spark, sf):
    b = _bronze(spark, sf)
    existing = b.where(F.col("row_id") % 3 == 0)
    return IG.incremental_new_rows(b.select("row_id", "payload_hash"), existing)


_CONVERSION_SQL = " OR ".join([f"lower(event_name) LIKE '%{t}%'" for t in FV.CONVERSION_TOKENS_LOWER]
                              + [f"event_name LIKE '%{t}%'" for t in FV.CONVERSION_TOKENS_RAW])
_NO = "CAST(NULL AS VARCHAR)"
# members of every kind; pc: named by a row of an earlier import
_MEMBERS_SQL = f"""facts AS (
  SELECT device_raw, source_name, media_key, date_key, report_date, device_key, campaign_key, COALESCE(campaign_name, campaign_code) AS campaign, campaign_code,
    ad_group_key, ad_group_name, ad_group_code, creative_key, creative_name, creative_code, {_NO} AS event_key, {_NO} AS event_name FROM ad
  UNION ALL SELECT device_raw, source_name, media_key, date_key, report_date, device_key, campaign_key, session_campaign, {_NO},
    {_NO}, {_NO}, {_NO}, creative_key, session_content, {_NO}, event_key, event_name FROM ga),
listed AS (
  SELECT device_raw = 'PC' AS pc, 'media' AS kind, media_key AS member_key, source_name, source_name AS name, {_NO} AS code, {_NO} AS category,
    CAST(NULL AS BOOLEAN) AS is_conversion FROM facts
  UNION ALL SELECT device_raw = 'PC', 'date', date_key, NULL, report_date, NULL, NULL, NULL FROM facts
  UNION ALL SELECT device_raw = 'PC', 'device', device_key, NULL, device_raw, NULL, {_device_group_sql('device_raw')}, NULL FROM facts
  UNION ALL SELECT device_raw = 'PC', 'campaign', campaign_key, source_name, campaign, campaign_code, NULL, NULL FROM facts
  UNION ALL SELECT device_raw = 'PC', 'ad_group', ad_group_key, source_name, ad_group_name, ad_group_code, NULL, NULL FROM facts
  UNION ALL SELECT device_raw = 'PC', 'creative', creative_key, source_name, creative_name, creative_code, NULL, NULL FROM facts
  UNION ALL SELECT device_raw = 'PC', 'event', event_key, NULL, event_name, NULL,
    CASE WHEN {_CONVERSION_SQL} THEN 'conversion' ELSE event_name END, ({_CONVERSION_SQL}) FROM facts
  UNION ALL SELECT FALSE, 'date', '0', NULL, '1000-01-01', NULL, 'unknown', NULL),
known AS (SELECT DISTINCT kind, member_key FROM listed WHERE member_key IS NOT NULL AND pc),
members AS (SELECT DISTINCT kind, member_key, source_name, name, code, category, is_conversion FROM listed WHERE member_key IS NOT NULL)"""


def _members(spark, sf):
    """The members of all facts, and those that an earlier import of the PC rows has loaded."""
    ad, ga = _silver(spark, sf)
    pc = F.col("device_raw") == "PC"
    earlier = IG.dimension_members(ad.where(pc), ga.where(pc)).where(F.col("member_key") != IG.UNKNOWN_DATE)
    return IG.dimension_members(ad, ga), earlier


@register("dimension_members", BASE_SQL + "," + _MEMBERS_SQL + "\nSELECT * FROM members")
def dimension_members(spark, sf):
    return IG.dim_merge(*_members(spark, sf))


@register("dim_dedupe", BASE_SQL + "," + _MEMBERS_SQL + "\nSELECT * FROM members ANTI JOIN known USING (kind, member_key)")
def dim_dedupe(spark, sf):
    return IG.dim_dedupe(*_members(spark, sf))


_LOOKUPS = {"campaign": ("campaign", "campaign_code"), "ad_group": ("ad_group_name", "ad_group_code"), "creative": ("creative_name", "creative_code")}


@register(
    "dim_lookup",
    BASE_SQL + "," + _MEMBERS_SQL + "\nSELECT a.row_id" + "".join(f", {k}.member_key AS {k}_id" for k in (*_LOOKUPS, "device")) + """ FROM ad a
""" + "".join(f"""LEFT JOIN members {k} ON {k}.kind = '{k}' AND {k}.source_name = a.source_name
  AND {k}.name IS NOT DISTINCT FROM {name} AND {k}.code IS NOT DISTINCT FROM a.{code}
""" for k, (name, code) in {**_LOOKUPS, "campaign": ("COALESCE(a.campaign_name, a.campaign_code)", "campaign_code"),
                            "ad_group": ("a.ad_group_name", "ad_group_code"), "creative": ("a.creative_name", "creative_code")}.items())
    + "LEFT JOIN members device ON device.kind = 'device' AND device.name = a.device_raw",
)
def dim_lookup(spark, sf):
    """J4 for every dimension with a natural key of its own: name and code, of which one may be missing."""
    ad, ga = _silver(spark, sf)
    members = materialize(IG.dimension_members(ad, ga), "members")
    blank = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  the natural key of a missing part; cells are never blank
    out = ad.withColumn("campaign", F.coalesce("campaign_name", "campaign_code"))
    for kind, (name, code) in _LOOKUPS.items():
        named = F.col(name).isNotNull() | F.col(code).isNotNull()
        out = out.withColumns({"_name": F.when(named, blank(F.col(name))), "_code": F.when(named, blank(F.col(code)))})
        dim = members.where(F.col("kind") == kind).select("source_name", blank(F.col("name")).alias("_name"), blank(F.col("code")).alias("_code"), "member_key")
        out = J.dim_lookup(out, dim, ["source_name", "_name", "_code"], "member_key", f"{kind}_id").drop("_name", "_code")
    devices = members.where("kind = 'device'").select(F.col("name").alias("device_raw"), "member_key")
    out = J.dim_lookup(out, devices, ["device_raw"], "member_key", "device_id")
    return out.select("row_id", *[f"{k}_id" for k in (*_LOOKUPS, "device")])


# ------------------------------------------------------------------ S8 / S9 on page-derived paths
_FOLDERS = ("DA 디스플레이", "SA검색", "GA", "etc", "DA/GA")
_SUFFIXES = ("_20240105", "_organic", "_BSA", "_commerce_202401", "")


def _page_paths(spark, sf):
    p = load(spark, sf, "pages")
    host = F.split(F.regexp_replace("url", r"^https?://", ""), r"\.").getItem(0)
    folder = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("page_id") % 5 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), ((F.col("page_id") * 3) % 5 + 1).cast("int"))
    return p.select("page_id", F.concat(F.lit("raw/"), folder, F.lit("/"), host, suffix, F.lit(".csv")).alias("file_path"))


_PATHS_SQL = f"""WITH paths AS (
  SELECT page_id, 'raw/' || [{", ".join(f"'{x}'" for x in _FOLDERS)}][page_id % 5 + 1] || '/' ||
    split_part(regexp_replace(url, '^https?://', ''), '.', 1) || [{", ".join(f"'{x}'" for x in _SUFFIXES)}][(page_id * 3) % 5 + 1] || '.csv' AS file_path
  FROM pages),
p2 AS (SELECT *, regexp_replace(file_path, '/[^/]*$', '') AS parent,
  regexp_replace(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\\.[^.]*$', ''), '_\\d{{4,8}}$', '') AS source_name,
  regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS folder FROM paths),
p3 AS (SELECT *, CASE WHEN parent LIKE '%DA%' THEN 'DA' WHEN parent LIKE '%SA%' THEN 'SA' END AS source_part,
  folder LIKE '%GA%' AS is_ga, source_name LIKE '%BSA%' AS is_bsa FROM p2),
p4 AS (SELECT *, CASE WHEN is_ga AND lower(source_name) LIKE '%organic%' THEN 'organic'
                      WHEN is_ga AND lower(source_name) LIKE '%commerce%' THEN 'commerce'
                      WHEN is_ga THEN 'GA' WHEN is_bsa THEN 'BSA' ELSE '매체' END AS source_group,
  regexp_replace(regexp_replace(lower(source_name), '\\W+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM p3)
"""


@register("route_by_path", _PATHS_SQL + "SELECT page_id, file_path, source_part FROM p4")
def route_by_path(spark, sf):
    p = _page_paths(spark, sf)
    return p.select("page_id", "file_path", IG.route_by_path(F.col("file_path")).alias("source_part"))


@register(
    "source_metadata",
    _PATHS_SQL + """SELECT page_id, source_part, source_group, source_name,
  CASE WHEN slug = '' THEN 'unknown' ELSE slug END AS media_code,
  CASE WHEN source_group = 'GA' THEN 'GA' WHEN source_group = 'BSA' THEN 'BSA' ELSE source_part END AS media_category,
  CASE WHEN is_ga THEN 'analytics' WHEN source_part = 'SA' THEN 'search_ad' ELSE 'ad_platform' END AS platform_type,
  CASE WHEN is_ga THEN 'fact_ga_daily' ELSE 'fact_ad_daily' END AS fact_target
FROM p4""",
)
def source_metadata(spark, sf):
    p = _page_paths(spark, sf)
    return p.select("page_id", IG.source_metadata(F.col("file_path")).alias("m")).select("page_id", "m.*")
