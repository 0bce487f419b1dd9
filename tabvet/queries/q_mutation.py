"""Queries for gated mutation (M1-M10) and the schema anti joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabvet.functions import headers as H
from tabvet.functions import semantics as S
from tabvet.operators import mutation as MU
from tabvet.operators import overlay as OV
from tabvet.operators import predicates as P
from tabvet.operators import publish as PB
from tabvet.plans import steps as L
from tabvet.queries.q_overlay import O1_ACTIONS, O1_GROUPS, _o1_where
from tabvet.queries.q_plans import ANC_SQL, EXT_SQL, _ext
from tabvet.queries.registry import register
from tabvet.session import shared_path
from tabvet.sources.derived import PLAN_SQL, plan_steps
from tabvet.sources.tables import STAGING_NUMERIC, header_cells, num_sql, stg_b, stg_m, with_staging

N = num_sql
_W = f"COALESCE(campaign = 'F' AND {N('cost')} > 300000, FALSE)"
ZERO_ACTIONS = [{"target_field": "cost", "operation": "set_zero"}, {"target_field": "sessions", "operation": "set_zero"}]
STG_B_COLS = ["row_id", "source_channel", "campaign", "day", "ad_group", "device", "cost", "sessions"]


@register(
    "update_set_zero",
    with_staging("stg_b")
    + f"""SELECT row_id, cost AS cost_before, CASE WHEN {_W} THEN '0' ELSE cost END AS cost,
  CASE WHEN {_W} THEN '0' ELSE sessions END AS sessions FROM stg_b""",
)
def update_set_zero(spark, sf):
    df = stg_b(spark, sf)
    MU.require_predicate(O1_GROUPS)
    out = MU.apply_update(df.withColumn("cost_before", F.col("cost")), _o1_where(df), ZERO_ACTIONS, protected=["row_id"])
    return out.select("row_id", "cost_before", "cost", "sessions")


@register(
    "update_set_literal",
    with_staging("stg_b") + "SELECT row_id, CASE WHEN device IN ('MO', 'mobile') THEN 'vip' ELSE ad_group END AS ad_group FROM stg_b",
)
def update_set_literal(spark, sf):
    df = stg_b(spark, sf)
    where = P.compile_condition({"field": "device", "operator": "in", "values": ["MO", "mobile"]}, df.columns, STAGING_NUMERIC)
    out = MU.apply_update(df, where, [{"target_field": "ad_group", "operation": "set_literal", "value": "vip"}])
    return out.select("row_id", "ad_group")


_HASH_SQL = "sha256(concat_ws('|', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in STG_B_COLS[1:]) + "))"


@register(
    "add_derived_value",
    with_staging("stg_b")
    + f"""SELECT 'SA' AS target_table, row_id AS source_row_id, {_HASH_SQL} AS source_row_hash, 'price_band' AS derived_key,
  'high' AS derived_value, 'r1' AS rule_id FROM stg_b WHERE {N('cost')} > 200000""",
)
def add_derived_value(spark, sf):
    df = stg_b(spark, sf).withColumn("source_row_hash", S.row_hash(STG_B_COLS[1:]))
    return MU.derived_values(df, S.num("cost") > 200000, "SA", "price_band", "high", "r1")


_JSON_SQL = "json_object(" + ", ".join(f"'{c}', {c}" for c in STG_B_COLS) + ")"


@register(
    "backup_rows",
    with_staging("stg_b")
    + f"""SELECT 'run-1' AS backup_scope, 'SA' AS target_table, row_id AS source_row_id, CAST(NULL AS VARCHAR) AS source_row_hash,
  CAST({_JSON_SQL} AS VARCHAR) AS before_json
FROM stg_b WHERE {_W} AND row_id % 4 <> 0""",
)
def backup_rows(spark, sf):
    df = stg_b(spark, sf).select(*STG_B_COLS)
    # rows with id % 4 = 0 were backed up by an earlier attempt of the same scope
    existing = MU.backup_rows(df.where(F.col("row_id") % 4 == 0), _o1_where(df), "run-1", "SA")
    return MU.backup_rows(df, _o1_where(df), "run-1", "SA", existing=existing)


@register(
    "rollback_update",
    with_staging("stg_b")
    + f"""SELECT row_id, cost AS cost_before, CASE WHEN {_W} THEN '0' ELSE cost END AS cost_after,
  cost AS cost_restored, sessions AS sessions_restored FROM stg_b""",
)
def rollback_update(spark, sf):
    df = stg_b(spark, sf).select(*STG_B_COLS)
    where = _o1_where(df)
    backups = MU.backup_rows(df, where, "run-1", "SA")
    after = MU.apply_update(df, where, ZERO_ACTIONS)
    restored = MU.rollback(after, backups, ["cost", "sessions"])
    return (
        df.select("row_id", F.col("cost").alias("cost_before"))
        .join(after.select("row_id", F.col("cost").alias("cost_after")), "row_id")
        .join(restored.select("row_id", F.col("cost").alias("cost_restored"), F.col("sessions").alias("sessions_restored")), "row_id")
    )


@register(
    "upsert_by_key",
    with_staging("stg_m")
    + f""", e AS (SELECT row_id AS source_row_id, 'old-' || campaign AS campaign_name,
                CAST({N('clicks_cell')} AS DOUBLE) AS impressions, 'unknown' AS device_type_std FROM stg_m WHERE row_id % 2 = 0 OR row_id % 3 = 0),
i AS (SELECT row_id AS source_row_id, campaign AS campaign_name, CAST({N('num_cell')} AS DOUBLE) AS impressions,
             lower(COALESCE(device_cell, '')) AS device_type_std FROM stg_m WHERE row_id % 3 <> 0)
SELECT COALESCE(e.source_row_id, i.source_row_id) AS source_row_id,
  CASE WHEN e.source_row_id IS NOT NULL THEN e.campaign_name ELSE i.campaign_name END AS campaign_name,
  CASE WHEN i.source_row_id IS NOT NULL THEN i.impressions ELSE e.impressions END AS impressions,
  CASE WHEN i.source_row_id IS NOT NULL THEN i.device_type_std ELSE e.device_type_std END AS device_type_std
FROM e FULL OUTER JOIN i ON e.source_row_id = i.source_row_id""",
)
def upsert_by_key(spark, sf):
    m = stg_m(spark, sf)
    existing = m.where((F.col("row_id") % 2 == 0) | (F.col("row_id") % 3 == 0)).select(
        F.col("row_id").alias("source_row_id"), F.concat(F.lit("old-"), "campaign").alias("campaign_name"),
        S.num("clicks_cell").cast("double").alias("impressions"), F.lit("unknown").alias("device_type_std"))
    incoming = m.where(F.col("row_id") % 3 != 0).select(
        F.col("row_id").alias("source_row_id"), F.col("campaign").alias("campaign_name"),
        S.num("num_cell").cast("double").alias("impressions"), F.lower(F.coalesce("device_cell", F.lit(""))).alias("device_type_std"))
    return MU.upsert_by_key(existing, incoming, ["source_row_id"], ["impressions", "device_type_std"])


_O1W = f"campaign = 'F' AND {N('cost')} > 300000"


@register(
    "change_audit",
    with_staging("stg_b")
    + f"""SELECT 'run-1' AS run_id, 'SA' AS target_table, row_id AS source_row_id, 'cost' AS field_name, cost AS before_value,
  '0' AS after_value FROM stg_b WHERE {_O1W}
UNION ALL SELECT 'run-1', 'SA', row_id, 'sessions', sessions, '0' FROM stg_b WHERE {_O1W}
UNION ALL SELECT 'run-1', 'SA', row_id, 'ad_group', ad_group, 'vip' FROM stg_b WHERE {_O1W}""",
)
def change_audit(spark, sf):
    df = stg_b(spark, sf)
    return MU.change_audit(OV.explode_delta(OV.preview_update_delta(df, _o1_where(df), O1_ACTIONS)), "run-1", "SA")


def _gate_inputs(spark, sf):
    s = plan_steps(spark, sf)
    t = F.col("step_order") - 1
    n = F.length("text")
    sql_fp = S.fingerprint("text")
    prev_fp = S.fingerprint(F.concat("step_key", "text"))
    previews = s.select(
        "plan_id", "step_order", sql_fp.alias("sql_fingerprint"), prev_fp.alias("preview_fingerprint"),
        F.when(n % 7 == 0, F.lit("failed")).otherwise(F.lit("passed")).alias("validation_status"),
        F.when(t % 5 == 3, F.lit("executed")).otherwise(F.lit("pending_user_confirmation")).alias("preview_status"))
    approvals = s.where(n % 3 != 1).select(
        "plan_id", "step_order", (n % 4 != 0).alias("approved"),
        F.when(t % 4 == 2, F.lit("stale")).otherwise(sql_fp).alias("approved_sql_fingerprint"),
        prev_fp.alias("approved_preview_fingerprint"))
    return previews, approvals


@register(
    "gate_check",
    "WITH " + PLAN_SQL + """,
pv AS (SELECT plan_id, step_order, substr(sha256(text), 1, 16) AS sql_fp, substr(sha256(step_key || text), 1, 16) AS prev_fp,
        CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'passed' END AS validation_status,
        CASE WHEN turn % 5 = 3 THEN 'executed' ELSE 'pending_user_confirmation' END AS preview_status FROM plan_steps),
ap AS (SELECT plan_id, step_order, length(text) % 4 <> 0 AS approved,
        CASE WHEN turn % 4 = 2 THEN 'stale' ELSE substr(sha256(text), 1, 16) END AS a_sql, substr(sha256(step_key || text), 1, 16) AS a_prev
       FROM plan_steps WHERE length(text) % 3 <> 1)
SELECT pv.plan_id, pv.step_order,
  (validation_status = 'passed' AND preview_status = 'pending_user_confirmation' AND COALESCE(ap.approved, FALSE)
   AND COALESCE(ap.a_sql = pv.sql_fp, FALSE) AND COALESCE(ap.a_prev = pv.prev_fp, FALSE)) AS can_execute
FROM pv LEFT JOIN ap ON ap.plan_id = pv.plan_id AND ap.step_order = pv.step_order""",
)
def gate_check(spark, sf):
    previews, approvals = _gate_inputs(spark, sf)
    return MU.gate_check(previews, approvals, ["plan_id", "step_order"]).drop("refused_by")


@register(
    "overlay_update_block",
    "WITH RECURSIVE " + EXT_SQL + ",\n" + ANC_SQL + """,
tg AS (SELECT DISTINCT plan_id, step_key AS ancestor_key, split_part(unnest(actions), ':', 2) AS col FROM ext),
oc AS (SELECT a.plan_id, a.step_key, list_distinct(list(tg.col)) AS overlay_columns
       FROM (SELECT DISTINCT * FROM anc) a JOIN tg ON tg.plan_id = a.plan_id AND tg.ancestor_key = a.ancestor_key
       GROUP BY a.plan_id, a.step_key),
x AS (SELECT e.plan_id, e.step_order, e.step_key, e.intent_type,
        CASE WHEN e.turn % 3 = 0 THEN ['cost', 'campaign'] ELSE ['campaign'] END AS pc,
        COALESCE(oc.overlay_columns, CAST([] AS VARCHAR[])) AS ocs
      FROM ext e LEFT JOIN oc ON oc.plan_id = e.plan_id AND oc.step_key = e.step_key),
y AS (SELECT *, list_sort(list_intersect(pc, ocs)) AS unsafe FROM x)
SELECT plan_id, step_order, step_key, (intent_type = 'UPDATE_NUMERIC_VALUE' AND len(unsafe) > 0) AS blocked,
  CASE WHEN intent_type = 'UPDATE_NUMERIC_VALUE' AND len(unsafe) > 0 THEN array_to_string(unsafe, ',') END AS unsafe_columns
FROM y""",
)
def overlay_update_block(spark, sf):
    s = _ext(spark, sf)
    closure = L.transitive_closure(L.plan_edges(s))
    targets = s.select("plan_id", F.col("step_key").alias("ancestor_key"),
                       F.explode(F.transform("actions", lambda a: F.split(a, ":").getItem(1))).alias("col")).distinct()
    overlay_cols = closure.join(targets, ["plan_id", "ancestor_key"]).groupBy("plan_id", "step_key").agg(
        F.collect_set("col").alias("overlay_columns"))
    t = F.col("step_order") - 1
    x = s.join(overlay_cols, ["plan_id", "step_key"], "left").select(
        "plan_id", "step_order", "step_key", "intent_type",
        F.when(t % 3 == 0, F.array(F.lit("cost"), F.lit("campaign"))).otherwise(F.array(F.lit("campaign"))).alias("predicate_columns"),
        F.coalesce("overlay_columns", F.array().cast("array<string>")).alias("overlay_columns"))
    return MU.overlay_update_block(x).select("plan_id", "step_order", "step_key", "blocked", "unsafe_columns")


@register(
    "predicate_required",
    "WITH " + EXT_SQL + """,
c AS (SELECT *, CASE WHEN plan_id % 29 = 3 THEN ['1 = 1'] WHEN plan_id % 29 = 5 THEN list_append(conditions, ' 1=1') ELSE conditions END AS cs FROM ext)
SELECT plan_id, step_order, step_key, CASE WHEN intent_type <> 'UPDATE_NUMERIC_VALUE' THEN NULL
  WHEN len(cs) = 0 THEN 'update_requires_modification_predicate'
  WHEN len(list_filter(cs, lambda x: replace(x, ' ', '') = '1=1')) > 0 THEN 'update_predicate_tautology' END AS refused FROM c""",
)
def predicate_required(spark, sf):
    k = F.col("plan_id") % 29
    always = F.when(k == 3, F.array(F.lit("1 = 1"))).when(k == 5, F.array_append("conditions", F.lit(" 1=1"))).otherwise(F.col("conditions"))
    return _ext(spark, sf).select("plan_id", "step_order", "step_key", MU.write_refusal(F.col("intent_type"), always).alias("refused"))


_B_GROUPS = [{"join": "and", "conditions": [{"field": "device", "operator": "in", "values": ["MO", "mobile"]}]}]
_B_WHERE = "COALESCE(device IN ('MO', 'mobile'), FALSE)"


@register(
    "gated_publish",
    with_staging("stg_b")
    + f"""SELECT 3 AS version, row_id, CASE WHEN {_W} THEN '0' ELSE cost END AS cost, CASE WHEN {_W} THEN '0' ELSE sessions END AS sessions, ad_group,
  CASE WHEN {_W} THEN CAST({_JSON_SQL} AS VARCHAR) END AS backup, {_B_WHERE} AS rolled_back
FROM stg_b""",
)
def gated_publish(spark, sf):
    """M3, M7, M1, M9 and M4 in one path: an update, a second one, its rollback; the result is read from what was published."""
    df = stg_b(spark, sf).select(*STG_B_COLS)
    table = PB.Snapshots(spark, shared_path(spark, "published", uuid.uuid4().hex))
    table.publish(df, None, {"operation": "load"})
    where = P.compile_condition(_B_GROUPS[0]["conditions"][0], df.columns, STAGING_NUMERIC)
    vip = [{"target_field": "ad_group", "operation": "set_literal", "value": "vip"}]
    for scope, groups, cond, actions in (("run-1", O1_GROUPS, _o1_where(df), ZERO_ACTIONS), ("run-2", _B_GROUPS, where, vip)):
        approval = {"approved": True, **PB.preview(table, groups, actions)}
        PB.gated_update(table, groups, cond, actions, approval, scope, "SA", protected=["row_id"])
    version = PB.gated_rollback(table, "run-2", "SA", ["ad_group"])
    backups = table.backups()
    first = backups.where("backup_scope = 'run-1'").select(F.col("source_row_id").alias("row_id"), F.col("before_json").alias("backup"))
    second = backups.where("backup_scope = 'run-2'").select(F.col("source_row_id").alias("row_id"), F.lit(True).alias("rolled_back"))
    now = table.read().join(first, "row_id", "left").join(second, "row_id", "left")
    return now.select(F.lit(version).alias("version"), "row_id", "cost", "sessions", "ad_group", "backup",
                      F.coalesce("rolled_back", F.lit(False)).alias("rolled_back"))


# action targets synthesised per conversation turn (configuration)
LABEL_TARGETS = ("분류값", "상태 값", "cost", "신규  구분값")
_LIVE_EXTRA = ("상태 값",)


@register(
    "route_label_updates",
    f"""WITH a AS (
  SELECT conv_id, turn, ['분류값', '상태 값', 'cost', '신규  구분값'][(conv_id % 4) + 1] AS target_field,
         text || CASE WHEN turn % 2 = 0 THEN ' 분류 붙여줘' ELSE '' END AS text FROM conversations),
live(column_name) AS (VALUES {", ".join(f"('{c}')" for c in [*STG_B_COLS, *_LIVE_EXTRA])}),
t AS (SELECT *, trim(regexp_replace(target_field, '\\s+', ' ', 'g')) AS tf FROM a)
SELECT conv_id, turn, target_field,
  CASE WHEN ({" OR ".join(f"text LIKE '%{x}%'" for x in MU.LABEL_TEXT_TOKENS)})
        AND ({" OR ".join(f"tf LIKE '%{x}%'" for x in MU.LABEL_FIELD_TOKENS)})
        AND target_field NOT IN (SELECT column_name FROM live) THEN 'derived_value' ELSE 'raw_update' END AS route
FROM t""",
)
def route_label_updates(spark, sf):
    from tabvet.sources.tables import load

    c = load(spark, sf, "conversations")
    targets = F.element_at(F.array(*[F.lit(x) for x in LABEL_TARGETS]), (F.col("conv_id") % 4 + 1).cast("int"))
    actions = c.select("conv_id", "turn", targets.alias("target_field"),
                       F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(" 분류 붙여줘")).otherwise(F.lit(""))).alias("text"))
    live = spark.createDataFrame([(x,) for x in [*STG_B_COLS, *_LIVE_EXTRA]], "column_name string")
    return MU.route_label_updates(actions, live).select("conv_id", "turn", "target_field", "route")


# ------------------------------------------------------------------ J8 / J9
PROTECTED_POLICY = [("SA", "비용", True), ("SA", "캠페인", False), ("SA", "노출수", True)]


def _canon_candidates(spark, sf):
    h = header_cells(spark, sf)
    return h.select(F.lit("SA").alias("target_table"), H.canonical_header("raw_header").alias("column_name")).where(
        F.col("column_name") != "").distinct()


def _canon_sql() -> str:
    from tabvet.queries.q_projections import _CANON_CASE, _ID_SQL

    return with_staging("header_cells") + f""", b AS (SELECT raw_header, trim(regexp_replace(raw_header, '\\s+', ' ', 'g')) AS base FROM header_cells),
k AS (SELECT *, lower(regexp_replace(base, '\\s+', '', 'g')) AS key FROM b),
cand AS (SELECT DISTINCT 'SA' AS target_table, CASE WHEN {_ID_SQL} THEN base {_CANON_CASE} ELSE base END AS column_name FROM k),
c2 AS (SELECT * FROM cand WHERE column_name <> '')
"""


_NT = "lower(regexp_replace(column_name, '\\s+', '', 'g'))"


@register(
    "protected_policy_anti",
    _canon_sql()
    + f""", pol(target_table, column_name, active) AS (VALUES {", ".join(f"('{t}', '{c}', {str(a).upper()})" for t, c, a in PROTECTED_POLICY)})
SELECT target_table, column_name FROM c2
WHERE NOT EXISTS (SELECT 1 FROM pol WHERE pol.active AND pol.target_table = c2.target_table AND pol.column_name = c2.column_name)
  AND column_name NOT IN ({', '.join(repr(c) for c in MU.PROTECTED_WRITE_COLUMNS)})
  AND NOT ({_NT} IN ('id', '아이디') OR {_NT} LIKE '%id' OR {_NT} LIKE '%아이디' OR {_NT} LIKE '%sourcechannel%' OR {_NT} LIKE '%rawsource%')""",
)
def protected_policy_anti(spark, sf):
    pol = spark.createDataFrame(PROTECTED_POLICY, "target_table string, column_name string, active boolean")
    return MU.writable_targets(_canon_candidates(spark, sf), pol)


@register(
    "unknown_columns_anti",
    _canon_sql()
    + f""", live(column_name) AS (VALUES {", ".join(f"('{c}')" for c in ["노출수", "클릭수", "비용", "캠페인", "날짜", "디바이스"])})
SELECT target_table, column_name FROM c2 WHERE column_name NOT IN (SELECT column_name FROM live)""",
)
def unknown_columns_anti(spark, sf):
    cat = spark.createDataFrame([("SA", c) for c in ["노출수", "클릭수", "비용", "캠페인", "날짜", "디바이스"]], "target_table string, column_name string")
    return MU.unknown_columns(_canon_candidates(spark, sf), cat)
