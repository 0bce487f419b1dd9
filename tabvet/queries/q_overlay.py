"""Queries for previews, deltas and the what-if overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators import overlay as OV
from tabvet.operators import predicates as P
from tabvet.queries.registry import register
from tabvet.sources.derived import (
    AS_OF, AS_OF_SQL, CURRENT_STEP, DELTA_SQL, DELTA_STEPS, EVENTS_SQL, LIVE_SQL, delta_events, delta_items, derived_labels,
    derived_labels_sql,
)
from tabvet.sources.tables import STAGING_NUMERIC, num_sql, stg_b, with_staging

N = num_sql
OVERLAY_COLUMNS = ["cost", "sessions"]


def _ancestors_py(step: str) -> list[str]:
    """Ancestors of a step in the delta-plan spec (breadth-first over depends_on)."""
    out, todo = [], list(DELTA_STEPS[step][1])
    while todo:
        s = todo.pop(0)
        if s not in out:
            out.append(s)
            todo.extend(DELTA_STEPS[s][1])
    return out


_ANC = ", ".join(f"'{s}'" for s in _ancestors_py(CURRENT_STEP))
_CUR_ORDER = DELTA_STEPS[CURRENT_STEP][0]

LATEST_SQL = DELTA_SQL + f""",
app AS (SELECT * FROM delta WHERE {LIVE_SQL} AND target_table = 'SA'
        AND step_key IN ({_ANC}) AND step_order < {_CUR_ORDER}),
r AS (SELECT *, row_number() OVER (PARTITION BY source_row_id, column_name ORDER BY step_order DESC, delta_item_id DESC) AS rn FROM app),
lat AS (SELECT source_row_id, column_name, new_value, step_key, delta_item_id FROM r WHERE rn = 1),
ov AS (SELECT source_row_id,
         max(CASE WHEN column_name = 'cost' THEN 1 END) AS has_cost, max(CASE WHEN column_name = 'cost' THEN new_value END) AS cost_new,
         max(CASE WHEN column_name = 'sessions' THEN 1 END) AS has_sessions,
         max(CASE WHEN column_name = 'sessions' THEN new_value END) AS sessions_new
       FROM lat GROUP BY source_row_id),
eff AS (SELECT b.row_id, b.source_channel, b.campaign, b.cost AS raw_cost, b.sessions AS raw_sessions,
          CASE WHEN ov.has_cost = 1 THEN ov.cost_new ELSE b.cost END AS cost,
          CASE WHEN ov.has_sessions = 1 THEN ov.sessions_new ELSE b.sessions END AS sessions,
          COALESCE(ov.has_cost = 1, FALSE) AS has_cost_delta, ov.cost_new AS delta_cost
        FROM stg_b b LEFT JOIN ov ON b.row_id = ov.source_row_id)
"""


def _applicable(spark, sf):
    # the delta plan is a request spec (a handful of steps): its ancestors come
    # from the spec; plan tables use the distributed closure (step_ancestors)
    return OV.ancestor_deltas(delta_items(spark, sf), _ancestors_py(CURRENT_STEP), "p1", CURRENT_STEP, _CUR_ORDER, AS_OF, "SA")


def _overlay(spark, sf):
    return OV.overlay_map(OV.latest_delta(_applicable(spark, sf)))


# ------------------------------------------------------------------ O1 / O2 / O3
O1_ACTIONS = [
    {"target_field": "cost", "operation": "set_zero"},
    {"target_field": "sessions", "operation": "set_zero"},
    {"target_field": "ad_group", "operation": "set_literal", "value": "vip"},
]
_O1_WHERE = f"campaign = 'F' AND {N('cost')} > 300000"


O1_GROUPS = [{"conditions": [
    {"field": "campaign", "operator": "eq", "values": ["F"]},
    {"field": "cost", "operator": "gt", "values": ["300000"]},
]}]


def _o1_where(df):
    return P.compile_where(O1_GROUPS, df.columns, STAGING_NUMERIC)


@register(
    "preview_update_delta",
    with_staging("stg_b")
    + f"""SELECT row_id AS source_row_id, 'preview_update' AS delta_type, 'cost' AS column_name, cost AS old_value, '0' AS new_value
FROM stg_b WHERE {_O1_WHERE}
UNION ALL SELECT row_id, 'preview_update', 'sessions', sessions, '0' FROM stg_b WHERE {_O1_WHERE}
UNION ALL SELECT row_id, 'preview_update', 'ad_group', ad_group, 'vip' FROM stg_b WHERE {_O1_WHERE}""",
)
def preview_update_delta(spark, sf):
    df = stg_b(spark, sf)
    return OV.explode_delta(OV.preview_update_delta(df, _o1_where(df), O1_ACTIONS))


@register(
    "preview_derived_delta",
    with_staging("stg_b")
    + f"""SELECT row_id AS source_row_id, 'price_band' AS derived_key, CAST(NULL AS VARCHAR) AS before_value, 'high' AS after_value,
  'preview_derived' AS delta_type FROM stg_b WHERE {N('cost')} > 200000""",
)
def preview_derived_delta(spark, sf):
    df = stg_b(spark, sf)
    w = P.compile_condition({"field": "cost", "operator": "gt", "values": ["200000"]}, df.columns, STAGING_NUMERIC)
    d = OV.preview_derived_delta(df, w, "price_band", "high")
    return d.select("source_row_id", F.lit("price_band").alias("derived_key"),
                    F.element_at("before", "price_band").alias("before_value"),
                    F.element_at("after", "price_band").alias("after_value"), "delta_type")


@register(
    "delta_log_current",
    "WITH " + EVENTS_SQL + f""",
l AS (SELECT *, row_number() OVER (PARTITION BY delta_item_id ORDER BY seq DESC) AS rn FROM events)
SELECT delta_item_id, step_key, source_row_id, status FROM l
WHERE rn = 1 AND status <> 'replaced' AND (expires_at IS NULL OR expires_at > {AS_OF_SQL})""",
)
def delta_log_current(spark, sf):
    cur = OV.delta_log_current(delta_events(spark, sf), AS_OF)
    return cur.select("delta_item_id", "step_key", "source_row_id", "status")


# ------------------------------------------------------------------ W1 / O7 / O6 / J5
@register("latest_delta", "WITH " + LATEST_SQL + "SELECT * FROM lat")
def latest_delta(spark, sf):
    return OV.latest_delta(_applicable(spark, sf))


@register("overlay_ancestors_only", "WITH " + LATEST_SQL + "SELECT DISTINCT delta_item_id, step_key, source_row_id FROM app")
def overlay_ancestors_only(spark, sf):
    return _applicable(spark, sf).select("delta_item_id", "step_key", "source_row_id")


@register("overlay_column_choice", "WITH " + LATEST_SQL + "SELECT row_id, cost, sessions, raw_cost FROM eff")
def overlay_column_choice(spark, sf):
    raw = stg_b(spark, sf).select("row_id", "cost", "sessions", F.col("cost").alias("raw_cost"))
    return OV.apply_overlay(OV.join_overlay(raw, _overlay(spark, sf)), OVERLAY_COLUMNS)


@register("overlay_join", "WITH " + LATEST_SQL + "SELECT row_id, raw_cost, has_cost_delta, delta_cost FROM eff")
def overlay_join(spark, sf):
    raw = stg_b(spark, sf).select("row_id", F.col("cost").alias("raw_cost"))
    j = OV.join_overlay(raw, _overlay(spark, sf))
    return j.select(
        "row_id", "raw_cost",
        F.coalesce(F.map_contains_key("overlay", "cost"), F.lit(False)).alias("has_cost_delta"),
        F.element_at("overlay", "cost").alias("delta_cost"),
    )


# ------------------------------------------------------------------ O4 / O5 (D7 modes)
@register(
    "overlay_aggregate",
    "WITH " + LATEST_SQL + f"""SELECT source_channel, count(*) AS row_count,
  ROUND(CAST(SUM({N('cost')}) AS DOUBLE), 6) AS cost, ROUND(CAST(SUM({N('sessions')}) AS DOUBLE), 6) AS sessions
FROM eff WHERE {N('raw_cost')} > 100000 GROUP BY source_channel""",
)
def overlay_aggregate(spark, sf):
    raw = stg_b(spark, sf)
    where_raw = P.compile_condition({"field": "cost", "operator": "gt", "values": ["100000"]}, raw.columns, STAGING_NUMERIC)
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.round(F.sum(N_(F.col("cost"))).cast("double"), 6).alias("cost"),
            F.round(F.sum(N_(F.col("sessions"))).cast("double"), 6).alias("sessions")]
    return OV.overlay_aggregate(raw, _overlay(spark, sf), OVERLAY_COLUMNS, where_raw, ["source_channel"], aggs)


def N_(c):
    from tabvet.functions.semantics import num

    return num(c)


@register(
    "overlay_detail",
    "WITH " + LATEST_SQL + f"SELECT row_id, cost, sessions FROM eff WHERE {N('cost')} > 100000 ORDER BY row_id",
)
def overlay_detail(spark, sf):
    raw = stg_b(spark, sf).select("row_id", "cost", "sessions")
    where_eff = P.compile_condition({"field": "cost", "operator": "gt", "values": ["100000"]}, raw.columns, STAGING_NUMERIC)
    return OV.overlay_detail(raw, _overlay(spark, sf), OVERLAY_COLUMNS, where_eff)


# ------------------------------------------------------------------ J6 / O8
def _derived(spark, sf):
    labels = derived_labels(spark, sf, N_(F.col("cost")))
    return OV.ancestor_deltas(labels, _ancestors_py(CURRENT_STEP), "p1", CURRENT_STEP, _CUR_ORDER, AS_OF, "SA")


_SCOPED_SQL = "WITH " + derived_labels_sql(N("cost")) + f""",
scoped AS (SELECT * FROM derived WHERE linked_plan_id = 'p1' AND target_table = 'SA' AND {LIVE_SQL}
           AND step_key IN ({_ANC}) AND step_order < {_CUR_ORDER})
"""


@register(
    "semi_prior_delta",
    _SCOPED_SQL + "SELECT row_id, cost FROM stg_b WHERE row_id IN (SELECT source_row_id FROM scoped WHERE label_key IN ('price_band', 'other_key'))",
)
def semi_prior_delta(spark, sf):
    return OV.semi_prior_delta(stg_b(spark, sf), _derived(spark, sf), ["price_band", "other_key"]).select("row_id", "cost")


@register(
    "derived_scope",
    _SCOPED_SQL
    + f"""SELECT price_band, source_channel, count(*) AS row_count, ROUND(CAST(SUM({N('cost')}) AS DOUBLE), 6) AS cost
FROM stg_b JOIN (SELECT source_row_id, arg_max(label, step_order * 1000000000000 + delta_item_id) AS price_band
                 FROM scoped WHERE label_key = 'price_band' GROUP BY source_row_id) l ON l.source_row_id = row_id
GROUP BY price_band, source_channel""",
)
def derived_scope(spark, sf):
    scoped = OV.derived_scope(stg_b(spark, sf), _derived(spark, sf), "price_band")
    return scoped.groupBy("price_band", "source_channel").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum(N_(F.col("cost"))).cast("double"), 6).alias("cost"))


# ------------------------------------------------------------------ O9 / O10
_O9 = f"campaign = 'O' AND {N('cost')} > 400000"


@register(
    "preview_bundle",
    with_staging("stg_b")
    + f"""SELECT row_id, campaign, cost, (SELECT count(*) FROM stg_b WHERE {_O9}) AS affected_count,
  (SELECT count(*) FROM stg_b WHERE {_O9}) > 2 AS limited
FROM stg_b WHERE {_O9} ORDER BY row_id LIMIT 2""",
)
def preview_bundle(spark, sf):
    df = stg_b(spark, sf)
    w = P.compile_where([{"conditions": [
        {"field": "campaign", "operator": "eq", "values": ["O"]},
        {"field": "cost", "operator": "gt", "values": ["400000"]},
    ]}], df.columns, STAGING_NUMERIC)
    return OV.preview_bundle(df, w, ["row_id", "campaign", "cost"])


def _fp_sql(where: str) -> str:
    rows = f"""SELECT row_id AS source_row_id, 'cost' AS column_name, cost AS old_value, '0' AS new_value FROM stg_b WHERE {where}
      UNION ALL SELECT row_id, 'sessions', sessions, '0' FROM stg_b WHERE {where}
      UNION ALL SELECT row_id, 'ad_group', ad_group, 'vip' FROM stg_b WHERE {where}"""
    text = ("concat_ws('|', CAST(source_row_id AS VARCHAR), column_name, COALESCE(old_value, '<null>'), "
            "COALESCE(new_value, '<null>'))")
    return f"(SELECT count(*) AS n, bit_xor(CAST(('0x' || substr(sha256({text}), 1, 15)) AS BIGINT)) AS fp FROM ({rows}))"


@register(
    "preview_changed",
    with_staging("stg_b")
    + f"""SELECT o.n AS old_n, o.fp AS old_fp, n.n AS new_n, n.fp AS new_fp, (o.n <> n.n OR o.fp <> n.fp) AS changed
FROM {_fp_sql(_O1_WHERE)} o, {_fp_sql(_O1_WHERE + " AND device <> 'PC'")} n""",
)
def preview_changed(spark, sf):
    df = stg_b(spark, sf)
    cols = ["source_row_id", "column_name", "old_value", "new_value"]
    old = OV.delta_fingerprint(OV.explode_delta(OV.preview_update_delta(df, _o1_where(df), O1_ACTIONS)), cols)
    new = OV.delta_fingerprint(OV.explode_delta(OV.preview_update_delta(df, _o1_where(df) & (F.col("device") != "PC"), O1_ACTIONS)), cols)
    return OV.compare_fingerprints(old, new)
