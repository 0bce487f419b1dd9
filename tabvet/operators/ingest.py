"""Bronze -> silver -> gold ingest as set-based jobs.

The original loader walks files row by row with cached dimension lookups;
here every layer is one projection or join over all rows, and dimension
surrogate keys are content hashes, so no lookup round trip is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions.semantics import device_group, parse_date, parse_number, payload_hash
from tabvet.operators.joins import hash_key
from tabvet.operators.normalize import additional_metrics, canonical_payload_columns


# ------------------------------------------------------------------ paths
def _parent_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def route_by_path(path: Column) -> Column:
    """Any parent folder containing 'DA' -> DA, else 'SA' -> SA, else NULL."""
    parents = _parent_parts(path)
    return (F.when(F.exists(parents, lambda p: p.contains("DA")), F.lit("DA"))
            .when(F.exists(parents, lambda p: p.contains("SA")), F.lit("SA")))


def source_metadata(path: Column) -> Column:
    """Struct of source part/group/name, media code, category, platform
    type and fact target derived from a file path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    file_name = F.element_at(parts, -1)
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    source_name = F.regexp_replace(stem, r"_\d{4,8}$", "")
    folder = F.when(n >= 2, F.element_at(parts, -2)).otherwise(F.lit("UNKNOWN"))
    part = route_by_path(path)
    is_ga = folder.contains("GA")
    is_bsa = source_name.contains("BSA")
    low = F.lower(source_name)
    group = (F.when(is_ga & low.contains("organic"), F.lit("organic"))
             .when(is_ga & low.contains("commerce"), F.lit("commerce"))
             .when(is_ga, F.lit("GA")).when(is_bsa, F.lit("BSA")).otherwise(F.lit("매체")))
    slug = F.regexp_replace(F.regexp_replace(low, r"(?U)\W+", "_"), r"^_+|_+$", "")
    media_code = F.when(slug == "", F.lit("unknown")).otherwise(slug)
    fact_target = F.when(is_ga, F.lit("fact_ga_daily")).otherwise(F.lit("fact_ad_daily"))
    category = F.when(group == "GA", F.lit("GA")).when(group == "BSA", F.lit("BSA")).otherwise(part)
    platform = (F.when(is_ga, F.lit("analytics")).when(part == "SA", F.lit("search_ad")).otherwise(F.lit("ad_platform")))
    return F.struct(part.alias("source_part"), group.alias("source_group"), source_name.alias("source_name"),
                    media_code.alias("media_code"), category.alias("media_category"), platform.alias("platform_type"),
                    fact_target.alias("fact_target"))


# ------------------------------------------------------------------ bronze
def bronze(rows: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Every non-blank row kept with its payload hash; ``parsed`` when a
    report date (date, else start date) parses, else ``bronze_only``."""
    m = F.col(payload_col)
    nonblank = F.exists(F.map_values(m), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    codes = canonical_payload_columns(m)
    # staged projections: each map lookup / parse is computed once, not
    # re-inlined into every reference of the date parser
    r = rows.where(nonblank).withColumn("_rd", F.coalesce(codes["report_date"], codes["report_start_date"]))
    r = r.withColumn("_d", parse_date(F.col("_rd")))
    d = F.col("_d")
    return r.select(
        *rows.columns, payload_hash(m).alias("payload_hash"), F.date_format(d, "yyyy-MM-dd").alias("report_date"),
        F.when(d.isNotNull(), F.lit("parsed")).otherwise(F.lit("bronze_only")).alias("parse_status"),
        F.when(d.isNull(), F.lit("missing_report_date")).alias("reason"),
    )


def incremental_new_rows(batch: DataFrame, existing: DataFrame, key: str = "payload_hash") -> DataFrame:
    """Only rows whose content hash is not ingested yet (anti join)."""
    return batch.join(existing.select(key).distinct(), key, "left_anti")


# ------------------------------------------------------------------ silver
def _canon(df: DataFrame, payload_col: str, fields: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Stage the needed canonical fields as plain columns (one lookup each)."""
    codes = canonical_payload_columns(F.col(payload_col))
    staged = df.withColumns({f"_c_{f}": codes[f] for f in fields})
    return staged, {f: F.col(f"_c_{f}") for f in fields}


_AD_FIELDS = ("campaign_name", "campaign_code", "ad_group_name", "ad_group_code", "creative_name", "creative_code",
              "device_raw", "impressions", "clicks", "cost_raw", "ctr")
_GA_FIELDS = ("session_campaign", "campaign_name", "session_content", "device_raw", "event_name", "sessions", "users", "key_events")
#: Kinds of dimension members, and the key of the date that is not known.
DIMENSIONS = ("media", "date", "campaign", "ad_group", "creative", "device", "event")
UNKNOWN_DATE, UNKNOWN_DATE_VALUE = "0", "1000-01-01"


def dimension_key(kind: str, source: Column, name: Column, code: Column, fall_back: bool = False) -> Column:
    """Surrogate key of a dimension member; NULL when the row has neither its name nor its code.
    With ``fall_back`` a missing name is replaced by the code, as the member is then listed under it."""
    label = F.coalesce(name, code) if fall_back else name
    return F.when(name.isNotNull() | code.isNotNull(), hash_key(F.lit(kind), source, label, code))


def _own_key(kind: str, value: Column) -> Column:
    """Key of a member that its value names whatever the source; NULL without a value."""
    return F.when(value.isNotNull(), hash_key(F.lit(kind), value))


def _date_key(report_date: Column) -> Column:
    return F.coalesce(F.replace(report_date, F.lit("-"), F.lit("")), F.lit(UNKNOWN_DATE))


def silver_ad_fact(parsed: DataFrame, payload_col: str = "payload", source_col: str = "source_name") -> DataFrame:
    """Typed ad facts: dimension keys, metrics defaulting to 0, nullable ctr,
    currency and the unmapped payload as JSON."""
    parsed, c = _canon(parsed, payload_col, _AD_FIELDS)
    consumed = [h for h, _ in FV.SOURCE_FIELD_CODES]
    extra = additional_metrics(F.col(payload_col), consumed)
    src = F.col(source_col)
    zero = F.lit(0.0)
    return parsed.select(
        "row_id", "report_date", src.alias("source_name"), _own_key("media", src).alias("media_key"), _date_key(F.col("report_date")).alias("date_key"),
        dimension_key("campaign", src, c["campaign_name"], c["campaign_code"], fall_back=True).alias("campaign_key"),
        dimension_key("ad_group", src, c["ad_group_name"], c["ad_group_code"]).alias("ad_group_key"),
        dimension_key("creative", src, c["creative_name"], c["creative_code"]).alias("creative_key"),
        _own_key("device", c["device_raw"]).alias("device_key"),
        *[c[f].alias(f) for f in ("campaign_name", "campaign_code", "ad_group_name", "ad_group_code", "creative_name", "creative_code", "device_raw")],
        F.coalesce(parse_number(c["impressions"]), zero).alias("impressions"),
        F.coalesce(parse_number(c["clicks"]), zero).alias("clicks"),
        F.coalesce(parse_number(c["cost_raw"]), zero).alias("cost_raw"),
        F.lit("KRW").alias("cost_currency"),
        parse_number(c["ctr"]).alias("ctr"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(extra)))).alias("additional_metrics"),
    )


def silver_ga_fact(parsed: DataFrame, payload_col: str = "payload", source_col: str = "source_name") -> DataFrame:
    """Session facts: dimension keys (campaigns and creatives by the session's
    names, which have no codes), sessions/users/key events default 0; the session
    campaign falls back to the campaign name."""
    parsed, c = _canon(parsed, payload_col, _GA_FIELDS)
    zero, src, no_code = F.lit(0.0), F.col(source_col), F.lit(None).cast("string")
    campaign = F.coalesce(c["session_campaign"], c["campaign_name"])
    return parsed.select(
        "row_id", "report_date", src.alias("source_name"), _own_key("media", src).alias("media_key"), _date_key(F.col("report_date")).alias("date_key"),
        dimension_key("campaign", src, campaign, no_code).alias("campaign_key"),
        dimension_key("creative", src, c["session_content"], no_code).alias("creative_key"),
        _own_key("device", c["device_raw"]).alias("device_key"), _own_key("event", c["event_name"]).alias("event_key"),
        campaign.alias("session_campaign"),
        c["session_content"].alias("session_content"), c["device_raw"].alias("device_raw"), c["event_name"].alias("event_name"),
        F.coalesce(parse_number(c["sessions"]), zero).alias("sessions"),
        F.coalesce(parse_number(c["users"]), zero).alias("users"),
        F.coalesce(parse_number(c["key_events"]), zero).alias("key_events"),
    )


# ------------------------------------------------------------------ gold
def gold_union(ad: DataFrame, ga: DataFrame) -> DataFrame:
    """Exactly one report row per ad fact and per GA fact; metrics a
    source does not have are 0."""
    z = F.lit(0.0)
    a = ad.select("report_date", "source_name", "device_raw", "campaign_name", F.col("creative_name").alias("creative_name_raw"),
                  "impressions", "clicks", "cost_raw", z.alias("sessions"), z.alias("users"),
                  F.col("row_id").alias("source_ad_fact_id"), F.lit(None).cast("long").alias("source_ga_fact_id"))
    g = ga.select("report_date", "source_name", "device_raw", F.col("session_campaign").alias("campaign_name"),
                  F.lit(None).cast("string").alias("creative_name_raw"), z.alias("impressions"), z.alias("clicks"),
                  z.alias("cost_raw"), "sessions", "users", F.lit(None).cast("long").alias("source_ad_fact_id"),
                  F.col("row_id").alias("source_ga_fact_id"))
    u = a.unionByName(g)
    return u.select(F.substring("report_date", 1, 7).alias("report_month"), "*", device_group("device_raw").alias("device_group"))


def gold_rollup(gold: DataFrame, keys: Sequence[str] = ("report_date", "source_name", "device_group")) -> DataFrame:
    """The read side of the gold index -- sums per (date, source, device)."""
    return gold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        # summed as decimals: exact and independent of the summation order
        *[F.round(F.sum(F.col(c).cast("decimal(38,6)")), 2).cast("double").alias(c)
          for c in ("impressions", "clicks", "cost_raw", "sessions", "users")],
    )


def load_stats(bronze_rows: DataFrame, key: str = "file_path") -> DataFrame:
    """Per imported file -- raw records, bronze-only rows, ad / GA facts
    and report rows, from one grouped pass over the bronze layer."""
    parsed = F.col("parse_status") == "parsed"
    ga = F.col("fact_target") == "fact_ga_daily"
    return bronze_rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if(~parsed).alias("bronze_only_rows"),
        F.count_if(parsed & ~ga).alias("fact_ad_daily"),
        F.count_if(parsed & ga).alias("fact_ga_daily"),
        F.count_if(parsed).alias("report_daily_row"),
    )


# ------------------------------------------------------------------ dimensions
_MEMBER = ("kind", "member_key", "source_name", "name", "code", "category", "is_conversion")


def _member(kind: str, key: Column, source: Column, name: Column, code: Column | None = None, category: Column | None = None,
            conversion: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), key.alias("member_key"), source.alias("source_name"), name.alias("name"),
                    (none if code is None else code).alias("code"), (none if category is None else category).alias("category"),
                    (F.lit(None).cast("boolean") if conversion is None else conversion).alias("is_conversion"))


def is_conversion(event: Column) -> Column:
    out = F.lit(False)
    for token in FV.CONVERSION_TOKENS_LOWER:
        out = out | F.lower(event).contains(token)
    for token in FV.CONVERSION_TOKENS_RAW:
        out = out | event.contains(token)
    return out


def dimension_members(ad: DataFrame, ga: DataFrame) -> DataFrame:
    """The members of all seven dimensions that the facts name, and the unknown date.

    Each fact row lists its members once; one aggregate over (kind, key), with partial
    sums before the shuffle, makes them distinct."""
    own, none = F.col, F.lit(None).cast("string")

    def common() -> list[Column]:
        return [
            _member("media", own("media_key"), own("source_name"), own("source_name")),
            _member("date", own("date_key"), none, own("report_date")),
            _member("device", own("device_key"), none, own("device_raw"), None, device_group("device_raw")),
        ]

    of_ad = ad.select(F.explode(F.array(
        *common(),
        _member("campaign", own("campaign_key"), own("source_name"), F.coalesce("campaign_name", "campaign_code"), own("campaign_code")),
        _member("ad_group", own("ad_group_key"), own("source_name"), own("ad_group_name"), own("ad_group_code")),
        _member("creative", own("creative_key"), own("source_name"), own("creative_name"), own("creative_code")),
    )).alias("m"))
    conversion = is_conversion(own("event_name"))
    of_ga = ga.select(F.explode(F.array(
        *common(),
        _member("campaign", own("campaign_key"), own("source_name"), own("session_campaign")),
        _member("creative", own("creative_key"), own("source_name"), own("session_content")),
        _member("event", own("event_key"), none, own("event_name"), None,
                F.when(conversion, F.lit("conversion")).otherwise(own("event_name")), conversion),
    )).alias("m"))
    unknown = ad.sparkSession.range(1).select(
        _member("date", F.lit(UNKNOWN_DATE), none, F.lit(UNKNOWN_DATE_VALUE), None, F.lit("unknown")).alias("m"))
    listed = of_ad.unionByName(of_ga).unionByName(unknown).select("m.*").where(F.col("member_key").isNotNull())
    return listed.groupBy("kind", "member_key").agg(*[F.min(c).alias(c) for c in _MEMBER[2:]])


def dim_dedupe(members: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert-if-absent -- the members whose (kind, key) the dimensions do not hold yet."""
    return members.join(existing.select("kind", "member_key"), ["kind", "member_key"], "left_anti")


def dim_merge(members: DataFrame, existing: DataFrame) -> DataFrame:
    """The dimensions after an import: members that are there keep their attributes, new ones are added."""
    return existing.unionByName(dim_dedupe(members, existing))
