"""Queries for filters and scopes (F1-F17) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators import metrics as M
from tabvet.operators import predicates as P
from tabvet.operators.catalog import distinct_channels
from tabvet.queries.registry import register
from tabvet.queries.sqlfrag import RATIO
from tabvet.sources.tables import STAGING_NUMERIC, num_sql, stg_a, stg_b, with_staging

N = num_sql


def _where(df, *conds, alias_map=None):
    return P.compile_where([{"conditions": list(conds)}], df.columns, STAGING_NUMERIC, alias_map)


# ------------------------------------------------------------------ flagship
FLAGSHIP_SPEC = {
    "selection": {"source_channels": ["A", "R"], "period": {"year": 1997, "month": 3}},
    "group_by": ["campaign"],
    "metrics": [
        {"alias": "impressions", "expression_type": "sum", "source_column": "impressions"},
        {"alias": "clicks", "expression_type": "sum", "source_column": "clicks"},
        {"alias": "ctr", "expression_type": "ctr", "source_column": "clicks"},
    ],
}


@register(
    "ctr_by_campaign",
    with_staging("stg_a")
    + f"""SELECT campaign,
  ROUND(CAST(SUM({N('impressions')}) AS DOUBLE), 6) AS impressions,
  ROUND(CAST(SUM({N('clicks')}) AS DOUBLE), 6) AS clicks,
  {RATIO('clicks', 'impressions', '0', True)} AS ctr
FROM stg_a
WHERE source_channel IN ('A', 'R')
  AND (day LIKE '1997-03%' OR day LIKE '1997.03%' OR day LIKE '1997. 3.%' OR day LIKE '199703%')
GROUP BY campaign ORDER BY campaign""",
)
def ctr_by_campaign(spark, sf):
    df = stg_a(spark, sf)
    sel = FLAGSHIP_SPEC["selection"]
    where = P.scope_channels("source_channel", sel["source_channels"]) & P.scope_month_text(
        "day", sel["period"]["year"], sel["period"]["month"], typed_twin="day_ts"
    )
    return M.aggregate(df, FLAGSHIP_SPEC["group_by"], FLAGSHIP_SPEC["metrics"], where, default_denominator="impressions")


# ------------------------------------------------------------------ F1..F8
@register("filter_eq", with_staging("stg_b") + f"SELECT row_id, sessions, campaign FROM stg_b WHERE {N('sessions')} = 0 AND campaign = 'F'")
def filter_eq(spark, sf):
    df = stg_b(spark, sf)
    w = _where(df, {"field": "sessions", "operator": "eq", "values": ["0"]}, {"field": "campaign", "operator": "eq", "values": ["F"]})
    return df.filter(w).select("row_id", "sessions", "campaign")


@register(
    "filter_in",
    with_staging("stg_b")
    + "SELECT row_id, source_channel, sessions FROM stg_b WHERE source_channel IN ('1-URGENT', '2-HIGH') AND sessions IN ('0', '1')",
)
def filter_in(spark, sf):
    df = stg_b(spark, sf)
    w = _where(
        df,
        {"field": "source_channel", "operator": "in", "values": ["1-URGENT", "2-HIGH"]},
        # eq with several values silently becomes a text IN
        {"field": "sessions", "operator": "eq", "values": ["0", "1"]},
    )
    return df.filter(w).select("row_id", "source_channel", "sessions")


@register("filter_contains", with_staging("stg_b") + "SELECT row_id, ad_group FROM stg_b WHERE ad_group LIKE '%grp_2%'")
def filter_contains(spark, sf):
    df = stg_b(spark, sf)
    # '_' inside the value stays a wildcard, as in the original LIKE
    return df.filter(_where(df, {"field": "ad_group", "operator": "contains", "values": ["grp_2"]})).select("row_id", "ad_group")


@register("filter_not_contains", with_staging("stg_b") + "SELECT row_id, ad_group FROM stg_b WHERE ad_group NOT LIKE '%grp-1%'")
def filter_not_contains(spark, sf):
    df = stg_b(spark, sf)
    return df.filter(_where(df, {"field": "ad_group", "operator": "not_contains", "values": ["grp-1"]})).select("row_id", "ad_group")


@register("filter_neq", with_staging("stg_b") + "SELECT row_id, ad_group FROM stg_b WHERE ad_group <> 'grp-3'")
def filter_neq(spark, sf):
    df = stg_b(spark, sf)
    return df.filter(_where(df, {"field": "ad_group", "operator": "neq", "values": ["grp-3"]})).select("row_id", "ad_group")


@register(
    "filter_range",
    with_staging("stg_b") + f"SELECT row_id, cost, sessions FROM stg_b WHERE {N('cost')} >= 300000 AND {N('sessions')} < 5",
)
def filter_range(spark, sf):
    df = stg_b(spark, sf)
    w = _where(df, {"field": "cost", "operator": "gte", "values": ["300,000"]}, {"field": "sessions", "operator": "lt", "values": ["5"]})
    return df.filter(w).select("row_id", "cost", "sessions")


@register("filter_between", with_staging("stg_b") + f"SELECT row_id, cost FROM stg_b WHERE {N('cost')} BETWEEN 100000 AND 150000")
def filter_between(spark, sf):
    df = stg_b(spark, sf)
    return df.filter(_where(df, {"field": "cost", "operator": "between", "values": ["100000", "150000"]})).select("row_id", "cost")


@register(
    "filter_blank",
    with_staging("stg_b")
    + """SELECT row_id,
  ad_group IS NULL AS is_null,
  TRIM(COALESCE(ad_group, '')) = '' AS is_empty,
  (ad_group IS NULL OR TRIM(ad_group) = '') AS is_null_or_empty,
  (ad_group IS NOT NULL AND TRIM(ad_group) <> '') AS is_not_null_or_empty
FROM stg_b""",
)
def filter_blank(spark, sf):
    df = stg_b(spark, sf)
    ops = ["is_null", "is_empty", "is_null_or_empty", "is_not_null_or_empty"]
    return df.select(
        "row_id", *[P.compile_condition({"field": "ad_group", "operator": o}, df.columns, STAGING_NUMERIC).alias(o) for o in ops]
    )


@register(
    "filter_bool_tree",
    with_staging("stg_b")
    + f"""SELECT row_id FROM stg_b
WHERE ((source_channel = '1-URGENT' AND {N('cost')} > 400000) OR (campaign = 'P' AND {N('sessions')} < 3))
  AND device IN ('mobile', 'MO')""",
)
def filter_bool_tree(spark, sf):
    df = stg_b(spark, sf)
    tree = {
        "operator": "or",
        "conditions": [
            {"operator": "and", "conditions": [
                {"field": "source_channel", "operator": "eq", "values": ["1-URGENT"]},
                {"field": "cost", "operator": "gt", "values": ["400000"]},
            ]},
            {"operator": "and", "conditions": [
                {"field": "campaign", "operator": "eq", "values": ["P"]},
                {"field": "sessions", "operator": "lt", "values": ["3"]},
            ]},
        ],
    }
    # an empty group that names its field is recovered to IN over its values
    recovered = {"field": "device", "operator": "or", "values": ["mobile", "MO"], "conditions": []}
    return df.filter(_where(df, tree, recovered)).select("row_id")


# ------------------------------------------------------------------ F9..F17
@register(
    "scope_month_text",
    with_staging("stg_b")
    + "SELECT row_id, day FROM stg_b WHERE day LIKE '1998-02%' OR day LIKE '1998.02%' OR day LIKE '1998. 2.%' OR day LIKE '199802%'",
)
def scope_month_text(spark, sf):
    df = stg_b(spark, sf)
    return df.filter(P.scope_month_text("day", 1998, 2)).select("row_id", "day")


@register("scope_period", with_staging("stg_b") + "SELECT row_id, day FROM stg_b WHERE day >= '1997-01-15' AND day <= '1997-03-31'")
def scope_period(spark, sf):
    df = stg_b(spark, sf)
    return df.filter(P.scope_period("day", "1997-01-15", "1997-03-31")).select("row_id", "day")


@register("scope_channels", with_staging("stg_b") + "SELECT row_id, source_channel FROM stg_b WHERE source_channel IN ('1-URGENT', '5-LOW')")
def scope_channels(spark, sf):
    df = stg_b(spark, sf)
    P.require_channels(distinct_channels(df), ["1-URGENT", "5-LOW"])
    return df.filter(P.scope_channels("source_channel", ["SA.1-URGENT", "5-LOW"], table="SA")).select("row_id", "source_channel")


@register("filter_case_insensitive", with_staging("stg_b") + "SELECT row_id, device FROM stg_b WHERE rtrim(strip_accents(lower(device))) = rtrim(strip_accents(lower('DÉSKTOP')))")
def filter_case_insensitive(spark, sf):
    df = stg_b(spark, sf)
    return df.filter(P.case_insensitive_eq("device", "DÉSKTOP")).select("row_id", "device")


ALIAS_MAP = {"segment": ["campaign", "source_channel"], "group": ["ad_group"]}


@register("alias_or_filter", with_staging("stg_b") + "SELECT row_id FROM stg_b WHERE campaign = 'P' OR source_channel = 'P'")
def alias_or_filter(spark, sf):
    df = stg_b(spark, sf)
    w = _where(df, {"field": "segment", "operator": "eq", "values": ["P"]}, alias_map=ALIAS_MAP)
    return df.filter(w).select("row_id")


@register(
    "value_normalised_match",
    with_staging("stg_b")
    + """, wanted(v) AS (VALUES ('SMART TV'), ('desk top'), ('Ipad tablet')),
resolved AS (
  SELECT w.v AS wanted, MIN(d.device) AS device
  FROM wanted w JOIN (SELECT DISTINCT device FROM stg_b) d
    ON lower(regexp_replace(d.device, '\\s+', '', 'g')) = lower(regexp_replace(w.v, '\\s+', '', 'g'))
  GROUP BY w.v)
SELECT s.row_id, s.device FROM stg_b s WHERE s.device IN (SELECT device FROM resolved)""",
)
def value_normalised_match(spark, sf):
    from tabvet.operators.joins import resolve_condition_values

    df = stg_b(spark, sf)
    resolved = resolve_condition_values(df, "device", ["SMART TV", "desk top", "Ipad tablet"])
    return df.join(F.broadcast(resolved.select("device")), "device", "left_semi").select("row_id", "device")


@register("or_recovery", with_staging("stg_b") + f"SELECT row_id FROM stg_b WHERE {N('sessions')} > 95 OR {N('cost')} > 95")
def or_recovery(spark, sf):
    df = stg_b(spark, sf)
    conds = P.or_recovery([
        {"field": "sessions", "operator": "gt", "values": ["95"]},
        {"field": "cost", "operator": "gt", "values": ["95"]},
    ])
    return df.filter(_where(df, *conds)).select("row_id")


@register("live_condition_prune", with_staging("stg_b") + "SELECT row_id FROM stg_b WHERE campaign = 'O' AND (device = 'PC' OR ad_group = 'grp-3')")
def live_condition_prune(spark, sf):
    df = stg_b(spark, sf)
    groups = P.prune_unknown_conditions(
        [{"conditions": [
            {"field": "campaign", "operator": "eq", "values": ["O"]}, {"field": "no_such_column", "operator": "eq", "values": ["x"]},
            # a group keeps its known children, at any depth, and goes only when it has none
            {"operator": "or", "conditions": [
                {"field": "device", "operator": "eq", "values": ["PC"]}, {"field": "no_such_column", "operator": "eq", "values": ["x"]},
                {"operator": "and", "conditions": [{"field": "ad_group", "operator": "eq", "values": ["grp-3"]},
                                                   {"field": "gone", "operator": "is_null"}]}]},
            {"operator": "or", "conditions": [{"field": "gone", "operator": "is_null"}]},
        ]}],
        df.columns,
    )
    return df.filter(P.compile_where(groups, df.columns, STAGING_NUMERIC)).select("row_id")


@register(
    "predicate_match_flags",
    with_staging("stg_b")
    + "SELECT row_id, COALESCE(campaign = 'F' AND device IN ('mobile', 'MO') AND ad_group LIKE '%grp-4%', FALSE) AS matches FROM stg_b",
)
def predicate_match_flags(spark, sf):
    df = stg_b(spark, sf)
    preds = [
        {"column": "campaign", "operator": "eq", "values": ["F"]},
        {"column": "device", "operator": "in", "values": ["mobile", "MO"]},
        {"column": "ad_group", "operator": "like", "values": ["grp-4"]},
    ]
    return df.select("row_id", P.match_flags(preds).alias("matches"))
