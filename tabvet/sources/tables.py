"""Table access (S10) and the staging views built from the driver tables.

The staging views stand in for the wide text staging tables of the original
tool: every value column is text, numbers are rendered through
``decimal(18,2)``, and a few cells are blanked deterministically so blank vs
NULL handling is exercised.  ``STAGING_SQL`` holds the same views as SQL for
the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.functions.semantics import day_text, text_of_decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# numeric (metric) columns of the staging views
STAGING_NUMERIC = ("impressions", "clicks", "cost", "sessions")

# fixed device spellings used to synthesise a device column
DEVICE_SPELLINGS = ("mobile", "Desktop ", "tablet", "MO", "smart tv", "PC", "iPad Tablet", "mobile web")


def load(spark: SparkSession, sf_dir: str, name: str, fan_out: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if fan_out else df


def spread(df: DataFrame) -> DataFrame:
    """Fan a scan out to the cluster's parallelism when it yields fewer splits
    than there are cores (a small single-file table), for CPU-heavy per-row
    work (regex parsing, hashing, text jobs). Large inputs already have more
    splits than cores, so at scale this adds nothing; filters and column
    pruning still reach the scan below the repartition."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()  # planning only, no job
    except Exception:  # noqa: BLE001 - e.g. a Connect session without RDD access
        return df
    return df.repartition(target) if splits < target else df


def _device_of(k: Column) -> Column:
    expr = None
    n = len(DEVICE_SPELLINGS)
    for i, s in enumerate(DEVICE_SPELLINGS):
        cond = (k % n) == i
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
    return expr


def stg_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display-like staging rows: lineitem joined to orders and part (no unique key)."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_shipdate",
    )
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_returnflag").alias("source_channel"),
        day_text("l_shipdate").alias("day"),
        F.col("p_type").alias("campaign"),
        F.col("p_brand").alias("ad_group"),
        F.col("o_orderpriority").alias("campaign_type"),
        _device_of(F.col("l_linenumber")).alias("device"),
        text_of_decimal("l_extendedprice").alias("impressions"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit("")).otherwise(text_of_decimal("l_quantity")).alias("clicks"),
        text_of_decimal("l_discount").alias("cost"),
        F.col("l_shipdate").alias("day_ts"),  # typed twin of `day` (lets scopes prune the scan)
    )


def stg_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-like staging rows keyed by ``row_id`` (= o_orderkey, unique)."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("row_id"),
        F.col("o_orderpriority").alias("source_channel"),
        F.col("o_orderstatus").alias("campaign"),
        day_text("o_orderdate").alias("day"),
        F.when(k % 7 == 0, F.lit(""))
        .when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit("grp-"), (F.col("o_custkey") % 50).cast("string")))
        .alias("ad_group"),
        _device_of(k).alias("device"),
        text_of_decimal("o_totalprice").alias("cost"),
        F.when(k % 17 == 0, F.lit("")).otherwise((F.col("o_custkey") % 97).cast("string")).alias("sessions"),
    )


def stg_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event staging rows keyed by ``row_id`` (= event_id, unique)."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("source_channel"),
        day_text("ts").alias("day"),
        F.col("user_id").cast("string").alias("user"),
        text_of_decimal("value").alias("value"),
        F.col("props"),
    )


def _device_sql(k: str) -> str:
    n = len(DEVICE_SPELLINGS)
    whens = " ".join(f"WHEN {k} % {n} = {i} THEN '{s}'" for i, s in enumerate(DEVICE_SPELLINGS))
    return f"CASE {whens} END"


def _dec_text(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


STAGING_SQL = {
    "stg_a": f"""stg_a AS (
  SELECT l.l_returnflag AS source_channel, strftime(l.l_shipdate, '%Y-%m-%d') AS day,
         p.p_type AS campaign, p.p_brand AS ad_group, o.o_orderpriority AS campaign_type,
         {_device_sql('l.l_linenumber')} AS device,
         {_dec_text('l.l_extendedprice')} AS impressions,
         CASE WHEN l.l_orderkey % 13 = 0 THEN '' ELSE {_dec_text('l.l_quantity')} END AS clicks,
         {_dec_text('l.l_discount')} AS cost
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)""",
    "stg_b": f"""stg_b AS (
  SELECT o_orderkey AS row_id, o_orderpriority AS source_channel, o_orderstatus AS campaign,
         strftime(o_orderdate, '%Y-%m-%d') AS day,
         CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL
              WHEN o_orderkey % 13 = 0 THEN '  ' ELSE 'grp-' || CAST(o_custkey % 50 AS VARCHAR) END AS ad_group,
         {_device_sql('o_orderkey')} AS device,
         {_dec_text('o_totalprice')} AS cost,
         CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey % 97 AS VARCHAR) END AS sessions
  FROM orders)""",
    "stg_e": f"""stg_e AS (
  SELECT event_id AS row_id, event_type AS source_channel, strftime(ts, '%Y-%m-%d') AS day,
         CAST(user_id AS VARCHAR) AS "user", {_dec_text('value')} AS value, props
  FROM events)""",
}

# D1 numeric cast in the oracle dialect
def num_sql(c: str) -> str:
    return f"TRY_CAST(NULLIF(REPLACE({c}, ',', ''), '') AS DECIMAL(18,2))"


def with_staging(*names: str, extra: str = "") -> str:
    """``WITH`` prefix for oracle SQL that uses the staging views."""
    parts = [STAGING_SQL[n] for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- messy cells
# Fixed spellings used to synthesise mixed-format text cells from `orders`.
DEVICE_CELLS = ("android", "iOS", "Mobile Web", "PC", "p", "컴퓨터", "Tablet", "태블릿", "", None, "smart tv", " MO ")
# Fixed header spellings (configuration) used to synthesise header cells.
HEADER_SPELLINGS = (
    "노출수", " 노출 ", "Impressions", "IMPRESSIONS", "클릭(전체)", "클릭 수", "비용", "총 비용",
    "지출 금액 (KRW)", "캠페인 이름", "캠페인", "캠페인 ID", "광고 그룹명", "광고세트 이름", "광고 소재명",
    "기기 카테고리", "PC/모바일 매체", "일자", "보고 시작", "보고 종료", "종료일", "캠페인 유형", "ad id",
    "source_channel", "", "  ", "세션수", "col\tname\x01x", "x" * 70, "Campaign", "campaign", "Campaign ",
)


def _case_list(k: Column, values) -> Column:
    n = len(values)
    expr = None
    for i, v in enumerate(values):
        cond = (k % n) == i
        lit = F.lit(v).cast("string")
        expr = F.when(cond, lit) if expr is None else expr.when(cond, lit)
    return expr


def _thousands(x: Column) -> Column:
    whole = F.floor(x).cast("long")
    return F.concat((F.floor(x / 1000)).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))


def stg_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-format text cells keyed by ``row_id`` (= o_orderkey)."""
    o = load(spark, sf_dir, "orders", fan_out=True)  # regex/CASE-heavy cells
    k = F.col("o_orderkey")
    p = F.col("o_totalprice")
    d = F.add_months(F.col("o_orderdate").cast("date"), 300)
    num_cases = [
        F.lit(""), F.lit("total"), F.lit("-"), _thousands(p),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")),
        F.concat(F.lit(" "), text_of_decimal(p), F.lit(" ")), F.lit("0"), F.lit("0.00"),
        F.concat(F.lit("$"), text_of_decimal(p)), F.lit("n/a"),
    ]
    date_cases = [
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy.MM.dd"), F.date_format(d, "yyyy. M. d."),
        F.date_format(d, "yyyyMMdd"), F.date_format(d, "yyyy/MM/dd"), F.lit(""), F.lit("total"),
        F.concat(F.date_format(d, "yyyy"), F.lit("-02-30")), F.date_format(d, "yyyy년 M월 d일"),
        F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit(" ")),
    ]

    def pick(cases):
        expr = None
        for i, c in enumerate(cases):
            cond = (k % len(cases)) == i
            expr = F.when(cond, c) if expr is None else expr.when(cond, c)
        return expr

    return o.select(
        k.alias("row_id"),
        F.col("o_orderpriority").alias("source_channel"),
        pick(num_cases).alias("num_cell"),
        pick(date_cases).alias("date_cell"),
        _case_list(k, DEVICE_CELLS).alias("device_cell"),
        F.when(k % 9 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("campaign"),
        F.concat(F.lit("s-"), F.col("o_orderpriority")).alias("session_campaign"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("cr-"), (F.col("o_custkey") % 20).cast("string"))).alias("creative"),
        F.concat(F.lit("ac-"), (k % 6).cast("string")).alias("ad_content"),
        _thousands(F.col("o_custkey") * 13 + 0.5).alias("clicks_cell"),
        F.date_format(F.col("o_orderdate"), "yyyy.MM.dd").alias("start_cell"),
    )


def header_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header-like text cells: one per order; 32 consecutive orders form one
    header row ('file'), so every group is bounded while the number of
    groups grows with the data."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.floor(k / 32).cast("long").alias("file_id"),
        (k % 32 + 1).cast("int").alias("pos"),
        _case_list(k * 7 + F.col("o_custkey"), HEADER_SPELLINGS).alias("raw_header"),
    )


def sql_str(s: str | None) -> str:
    """SQL literal for the oracle (control characters through chr())."""
    if s is None:
        return "NULL"
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32 or ord(ch) == 127:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return " || ".join(parts)


def _case_sql(k: str, values) -> str:
    n = len(values)
    return "CASE " + " ".join(f"WHEN {k} % {n} = {i} THEN {sql_str(v)}" for i, v in enumerate(values)) + " END"


def _thousands_sql(x: str) -> str:
    return (f"CAST(CAST(floor(({x}) / 1000) AS BIGINT) AS VARCHAR) || ',' || "
            f"lpad(CAST(CAST(floor({x}) AS BIGINT) % 1000 AS VARCHAR), 3, '0')")


_D = "(CAST(o_orderdate AS DATE) + INTERVAL 25 YEAR)"
STAGING_SQL["stg_m"] = f"""stg_m AS (
  SELECT o_orderkey AS row_id, o_orderpriority AS source_channel,
    CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'total' WHEN 2 THEN '-' WHEN 3 THEN {_thousands_sql('o_totalprice')}
      WHEN 4 THEN CAST(o_custkey % 100 AS VARCHAR) || '%' WHEN 5 THEN ' ' || {_dec_text('o_totalprice')} || ' '
      WHEN 6 THEN '0' WHEN 7 THEN '0.00' WHEN 8 THEN '$' || {_dec_text('o_totalprice')} ELSE 'n/a' END AS num_cell,
    CASE o_orderkey % 10 WHEN 0 THEN strftime({_D}, '%Y-%m-%d') WHEN 1 THEN strftime({_D}, '%Y.%m.%d')
      WHEN 2 THEN strftime({_D}, '%Y. %-m. %-d.') WHEN 3 THEN strftime({_D}, '%Y%m%d') WHEN 4 THEN strftime({_D}, '%Y/%m/%d')
      WHEN 5 THEN '' WHEN 6 THEN 'total' WHEN 7 THEN strftime({_D}, '%Y') || '-02-30'
      WHEN 8 THEN strftime({_D}, '%Y년 %-m월 %-d일') ELSE ' ' || strftime({_D}, '%Y-%m-%d') || ' ' END AS date_cell,
    {_case_sql('o_orderkey', DEVICE_CELLS)} AS device_cell,
    CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderstatus END AS campaign,
    's-' || o_orderpriority AS session_campaign,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'cr-' || CAST(o_custkey % 20 AS VARCHAR) END AS creative,
    'ac-' || CAST(o_orderkey % 6 AS VARCHAR) AS ad_content,
    {_thousands_sql('o_custkey * 13 + 0.5')} AS clicks_cell,
    strftime(o_orderdate, '%Y.%m.%d') AS start_cell
  FROM orders)"""
def stg_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stg_b`` under the canonical Korean headers (for catalogs); the
    campaign-type column spells one value three ways so normalised keys collide."""
    b = stg_b(spark, sf_dir)
    k = F.col("row_id")
    variant = (F.when(k % 3 == 0, F.col("campaign")).when(k % 3 == 1, F.lower("campaign"))
               .otherwise(F.concat(F.lower("campaign"), F.lit(" "))))
    return b.select(
        "row_id", "source_channel", F.col("campaign").alias("캠페인"), F.col("day").alias("날짜"),
        F.col("ad_group").alias("광고 그룹"), F.col("device").alias("디바이스"), F.col("cost").alias("비용"),
        F.col("sessions").alias("세션수"), variant.alias("캠페인 유형"),
    )


STAGING_SQL["stg_k"] = STAGING_SQL["stg_b"] + """,
stg_k AS (
  SELECT row_id, source_channel, campaign AS "캠페인", day AS "날짜", ad_group AS "광고 그룹", device AS "디바이스",
         cost AS "비용", sessions AS "세션수",
         CASE WHEN row_id % 3 = 0 THEN campaign WHEN row_id % 3 = 1 THEN lower(campaign) ELSE lower(campaign) || ' ' END AS "캠페인 유형"
  FROM stg_b)"""

STAGING_SQL["header_cells"] = f"""header_cells AS (
  SELECT CAST(floor(o_orderkey / 32) AS BIGINT) AS file_id, CAST(o_orderkey % 32 + 1 AS INTEGER) AS pos,
         {_case_sql('(o_orderkey * 7 + o_custkey)', HEADER_SPELLINGS)} AS raw_header
  FROM orders)"""
