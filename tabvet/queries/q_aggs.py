"""Queries for aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators import catalog as C
from tabvet.operators import metrics as M
from tabvet.operators import predicates as P
from tabvet.queries.registry import register
from tabvet.queries.sqlfrag import AVG, RATIO, S
from tabvet.sources.tables import STAGING_NUMERIC, num_sql, stg_a, stg_b, stg_e, with_staging

N = num_sql


@register("agg_count", with_staging("stg_a") + "SELECT source_channel, COUNT(*) AS row_count FROM stg_a GROUP BY source_channel")
def agg_count(spark, sf):
    return M.aggregate(stg_a(spark, sf), ["source_channel"], [{"alias": "row_count", "expression_type": "count"}])


@register(
    "agg_sum",
    with_staging("stg_a")
    + f"SELECT campaign_type, {S('impressions')} AS impressions, {S('clicks')} AS clicks, {S('cost')} AS cost FROM stg_a GROUP BY campaign_type",
)
def agg_sum(spark, sf):
    ms = [{"alias": c, "expression_type": "sum", "source_column": c} for c in ("impressions", "clicks", "cost")]
    return M.aggregate(stg_a(spark, sf), ["campaign_type"], ms)


@register(
    "agg_avg",
    with_staging("stg_a") + f"SELECT device, {AVG('clicks')} AS avg_clicks, {AVG('cost')} AS avg_cost FROM stg_a GROUP BY device",
)
def agg_avg(spark, sf):
    ms = [
        {"alias": "avg_clicks", "expression_type": "avg", "source_column": "clicks"},
        {"alias": "avg_cost", "expression_type": "avg", "source_column": "cost"},
    ]
    return M.aggregate(stg_a(spark, sf), ["device"], ms)


@register(
    "agg_event_count",
    with_staging("stg_e")
    + f"""SELECT day,
  ROUND(CAST(SUM(CASE WHEN source_channel IN ('purchase', 'signup') THEN {N('value')} ELSE 0 END) AS DOUBLE), 6) AS conversions,
  ROUND(CAST(SUM(CASE WHEN source_channel = 'purchase' THEN {N('value')} ELSE 0 END) AS DOUBLE), 6) AS purchases,
  ROUND(CAST(SUM(CASE WHEN source_channel LIKE '%err%' THEN {N('value')} ELSE 0 END) AS DOUBLE), 6) AS errors
FROM stg_e GROUP BY day""",
)
def agg_event_count(spark, sf):
    ms = [
        {"alias": "conversions", "expression_type": "event_count", "source_column": "value",
         "event_filter": {"column": "source_channel", "operator": "in", "values": ["purchase", "signup"]}},
        {"alias": "purchases", "expression_type": "event_count", "source_column": "value",
         "event_filter": {"column": "source_channel", "operator": "eq", "value": "purchase"}},
        {"alias": "errors", "expression_type": "event_count", "source_column": "value",
         "event_filter": {"field": "source_channel", "operator": "contains", "values": ["err"]}},
    ]
    return M.aggregate(stg_e(spark, sf), ["day"], ms)


@register(
    "ratio_ctr",
    with_staging("stg_a") + f"SELECT campaign, {RATIO('clicks', 'impressions', '0', True)} AS ctr FROM stg_a GROUP BY campaign",
)
def ratio_ctr(spark, sf):
    # denominator defaults to impressions when the spec gives none
    return M.aggregate(stg_a(spark, sf), ["campaign"], [{"alias": "ctr", "expression_type": "ctr", "source_column": "clicks"}],
                       default_denominator="impressions")


@register(
    "ratio_conversion_rate",
    with_staging("stg_a") + f"SELECT ad_group, day, {RATIO('clicks', 'cost', '0', True)} AS conversion_rate FROM stg_a GROUP BY ad_group, day",
)
def ratio_conversion_rate(spark, sf):
    m = {"alias": "conversion_rate", "expression_type": "conversion_rate", "source_column": "clicks",
         "denominator_column": "cost", "zero_fallback": 0}
    return M.aggregate(stg_a(spark, sf), ["ad_group", "day"], [m])


@register(
    "ratio_cost_per_conversion",
    with_staging("stg_a")
    + f"SELECT ad_group, day, {RATIO('cost', 'clicks', 'NULL', False)} AS cost_per_conversion FROM stg_a GROUP BY ad_group, day",
)
def ratio_cost_per_conversion(spark, sf):
    m = {"alias": "cost_per_conversion", "expression_type": "cost_per_conversion", "source_column": "cost",
         "denominator_column": "clicks", "zero_fallback": None}
    return M.aggregate(stg_a(spark, sf), ["ad_group", "day"], [m])


@register(
    "group_by_dims",
    with_staging("stg_a")
    + f"""SELECT source_channel, campaign_type, device, COUNT(*) AS row_count, {S('impressions')} AS impressions,
  {AVG('clicks')} AS avg_clicks, {RATIO('clicks', 'impressions', '0', True)} AS ctr
FROM stg_a WHERE {N('cost')} > 0
GROUP BY source_channel, campaign_type, device ORDER BY source_channel, campaign_type, device""",
)
def group_by_dims(spark, sf):
    df = stg_a(spark, sf)
    ms = [
        {"alias": "row_count", "expression_type": "count"},
        {"alias": "impressions", "expression_type": "sum", "source_column": "impressions"},
        {"alias": "avg_clicks", "expression_type": "avg", "source_column": "clicks"},
        {"alias": "ctr", "expression_type": "ctr", "source_column": "clicks", "denominator_column": "impressions"},
    ]
    where = P.compile_condition({"field": "cost", "operator": "gt", "values": ["0"]}, df.columns, STAGING_NUMERIC)
    return M.aggregate(df, ["source_channel", "campaign_type", "device"], ms, where)


# fixed metric registry used by the long metric table (configuration)
METRIC_REGISTRY = [("impressions", 1, "count"), ("clicks", 2, "count"), ("cost", 3, "currency")]
_REG_SQL = ", ".join(f"('{c}', {i}, '{u}')" for c, i, u in METRIC_REGISTRY)


@register(
    "metric_registry_long",
    with_staging("stg_a")
    + f""", daily AS (
  SELECT day, campaign, SUM({N('impressions')}) AS impressions, SUM({N('clicks')}) AS clicks, SUM({N('cost')}) AS cost
  FROM stg_a GROUP BY day, campaign),
lng AS (
  SELECT day, campaign, 'impressions' AS metric_code, impressions AS v FROM daily
  UNION ALL SELECT day, campaign, 'clicks', clicks FROM daily
  UNION ALL SELECT day, campaign, 'cost', cost FROM daily),
reg(metric_code, metric_id, unit) AS (VALUES {_REG_SQL})
SELECT l.day, l.campaign, r.metric_id, l.metric_code, r.unit, ROUND(CAST(l.v AS DOUBLE), 6) AS value
FROM lng l JOIN reg r ON l.metric_code = r.metric_code WHERE l.v IS NOT NULL""",
)
def metric_registry_long(spark, sf):
    df = stg_a(spark, sf)
    daily = df.groupBy("day", "campaign").agg(*[F.sum(M.num(c)).alias(c) for c in ("impressions", "clicks", "cost")])
    reg = spark.createDataFrame(METRIC_REGISTRY, "metric_code string, metric_id int, unit string")
    return M.metric_long(daily, ["day", "campaign"], ["impressions", "clicks", "cost"], reg)


# fixed metric definition dictionary (configuration rows)
METRIC_DEFINITIONS = [
    # metric_code, user_term, target_table, expression_type, source_column, denominator_column, zero_fallback, priority, active
    ("IMP", "노출", "DA", "sum", "impressions", None, None, 1, True),
    ("IMP_AVG", "노출", "DA", "avg", "impressions", None, None, 2, True),
    ("CLK", "클릭", "DA", "sum", "clicks", None, None, 1, True),
    ("CTR", "클릭률", "DA", "ctr", "clicks", "impressions", "0", 1, True),
    ("CTR_OLD", "클릭률", "DA", "ctr", "cost", "impressions", "0", 0, False),
    ("COST", "비용", "DA", "sum", "cost", None, None, 1, True),
    ("COST_SA", "비용", "SA", "avg", "cost", None, None, 0, True),
    ("CPC", "클릭당비용", "DA", "cost_per_conversion", "cost", "clicks", None, 1, True),
    ("CLK_DUP", "클릭수", "DA", "sum", "clicks", None, None, 3, True),
]
METRIC_DEF_SCHEMA = (
    "metric_code string, user_term string, target_table string, expression_type string, source_column string, "
    "denominator_column string, zero_fallback string, priority int, active boolean"
)


@register(
    "metrics_from_definitions",
    with_staging("stg_a")
    + f"""SELECT source_channel, {S('impressions')} AS imp, {S('clicks')} AS clk, {RATIO('clicks', 'impressions', '0', True)} AS ctr,
  {S('cost')} AS cost, {RATIO('cost', 'clicks', 'NULL', False)} AS cpc
FROM stg_a GROUP BY source_channel""",
)
def metrics_from_definitions(spark, sf):
    df = stg_a(spark, sf)
    defs = spark.createDataFrame(METRIC_DEFINITIONS, METRIC_DEF_SCHEMA)
    chosen = M.select_metric_definitions(defs, ["노출", "클릭", "클릭률", "비용", "클릭당비용", "클릭수"], "DA")
    # the chosen definitions are a handful of dictionary rows: collected to build the agg list
    specs = [
        {"alias": r["metric_code"].lower(), "expression_type": r["expression_type"], "source_column": r["source_column"],
         "denominator_column": r["denominator_column"], "zero_fallback": r["zero_fallback"]}
        for r in chosen.orderBy("metric_code").collect()
    ]
    return M.aggregate(df, ["source_channel"], specs)


@register(
    "column_distinct_counts",
    with_staging("stg_b")
    + "\n UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT CAST({c} AS VARCHAR)) AS distinct_count FROM stg_b"
        for c in ("row_id", "source_channel", "campaign", "day", "ad_group", "device", "cost", "sessions")
    ),
)
def column_distinct_counts(spark, sf):
    return C.column_distinct_counts(stg_b(spark, sf))


@register(
    "distinct_channels",
    with_staging("stg_a")
    + "SELECT DISTINCT source_channel FROM stg_a WHERE source_channel IS NOT NULL AND TRIM(source_channel) <> '' ORDER BY source_channel",
)
def distinct_channels(spark, sf):
    return C.distinct_channels(stg_a(spark, sf))


@register(
    "affected_count",
    with_staging("stg_b") + f"SELECT COUNT(*) AS affected_count FROM stg_b WHERE campaign = 'O' AND {N('cost')} > 200000",
)
def affected_count(spark, sf):
    df = stg_b(spark, sf)
    w = P.compile_where([{"conditions": [
        {"field": "campaign", "operator": "eq", "values": ["O"]},
        {"field": "cost", "operator": "gt", "values": ["200000"]},
    ]}], df.columns, STAGING_NUMERIC)
    return df.filter(w).agg(F.count(F.lit(1)).alias("affected_count"))
