"""Queries for sinks and logs (K1-K4, C3): write to the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabvet.functions.semantics import fingerprint
from tabvet.operators import catalog as C
from tabvet.operators import mutation as MU
from tabvet.queries.q_catalog import _VALUE_CATALOG_SQL
from tabvet.queries.q_mutation import _gate_inputs
from tabvet.queries.registry import register
from tabvet.session import shared_path
from tabvet.sources import sinks as K
from tabvet.sources.derived import PLAN_SQL, plan_steps
from tabvet.sources.tables import stg_b, stg_k, with_staging


def _dir(spark, name):
    return shared_path(spark, "sinks", uuid.uuid4().hex, name)


@register(
    "write_staging_snapshot",
    with_staging("stg_b") + "SELECT source_channel, count(*) AS row_count, count(DISTINCT row_id) AS row_ids FROM stg_b GROUP BY source_channel",
)
def write_staging_snapshot(spark, sf):
    path = _dir(spark, "SA")
    K.write_staging_snapshot(stg_b(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("source_channel").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("row_id").alias("row_ids"))


@register(
    "write_batch_log",
    with_staging("stg_b")
    + """SELECT 'batch-1' AS batch_id, 'success' AS status,
  '{"channels": ' || CAST(count(DISTINCT source_channel) AS VARCHAR) || ', "row_count": ' || CAST(count(*) AS VARCHAR) || '}' AS stats_json,
  CAST(NULL AS VARCHAR) AS message FROM stg_b""",
)
def write_batch_log(spark, sf):
    return K.write_with_batch_log(stg_b(spark, sf), _dir(spark, "data"), _dir(spark, "batch_log"), "batch-1")


@register(
    "append_audit_jsonl",
    "WITH " + PLAN_SQL + """
SELECT plan_id, step_key, intent_type, substr(sha256(text), 1, 16) AS fingerprint FROM plan_steps""",
)
def append_audit_jsonl(spark, sf):
    s = plan_steps(spark, sf).select("plan_id", "step_key", "intent_type", fingerprint("text").alias("fingerprint"))
    path = _dir(spark, "audit")
    K.append_audit_jsonl(s, path)
    return spark.read.schema("plan_id long, step_key string, intent_type string, fingerprint string").json(path)


@register(
    "write_execution_log",
    "WITH " + PLAN_SQL + """,
pv AS (SELECT plan_id, step_order, text, substr(sha256(text), 1, 16) AS sql_fp, substr(sha256(step_key || text), 1, 16) AS prev_fp,
        CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'passed' END AS validation_status,
        CASE WHEN turn % 5 = 3 THEN 'executed' ELSE 'pending_user_confirmation' END AS preview_status FROM plan_steps),
ap AS (SELECT plan_id, step_order, length(text) % 4 <> 0 AS approved,
        CASE WHEN turn % 4 = 2 THEN 'stale' ELSE substr(sha256(text), 1, 16) END AS a_sql, substr(sha256(step_key || text), 1, 16) AS a_prev
       FROM plan_steps WHERE length(text) % 3 <> 1),
g AS (SELECT pv.plan_id, pv.step_order, pv.sql_fp, pv.prev_fp, validation_status, preview_status, approved, a_sql,
  (validation_status = 'passed' AND preview_status = 'pending_user_confirmation' AND COALESCE(ap.approved, FALSE)
   AND COALESCE(ap.a_sql = pv.sql_fp, FALSE) AND COALESCE(ap.a_prev = pv.prev_fp, FALSE)) AS can_execute
  FROM pv LEFT JOIN ap ON ap.plan_id = pv.plan_id AND ap.step_order = pv.step_order)
SELECT text AS request_text, CAST(json_object('plan_id', plan_id, 'step_order', step_order) AS VARCHAR) AS ir_json, step_key AS statement,
  CAST(json_array(step_key, CAST(step_order AS VARCHAR)) AS VARCHAR) AS params_json, sql_fp AS sql_fingerprint,
  CAST(CASE WHEN can_execute THEN step_order ELSE 0 END AS BIGINT) AS affected_row_count, CASE WHEN can_execute THEN 'executed' ELSE 'skipped' END AS status,
  CASE WHEN can_execute THEN CAST(json_object('step_order', step_order, 'preview', prev_fp) AS VARCHAR) END AS rollback_json,
  CASE WHEN can_execute THEN NULL WHEN validation_status <> 'passed' THEN 'validation' WHEN preview_status <> 'pending_user_confirmation' THEN 'preview'
    WHEN approved IS NOT TRUE THEN 'approval' WHEN a_sql <> sql_fp THEN 'sql_fingerprint' ELSE 'preview_fingerprint' END AS error_message
FROM g JOIN plan_steps USING (plan_id, step_order)""",
)
def write_execution_log(spark, sf):
    """K4: a record for every step, run or refused, with what undoes it or why it was refused."""
    previews, approvals = _gate_inputs(spark, sf)
    key = ["plan_id", "step_order"]
    steps = plan_steps(spark, sf).select(*key, "step_key", "text")
    gate = MU.gate_check(previews, approvals, key).join(previews.select(*key, "sql_fingerprint", "preview_fingerprint"), key).join(steps, key)
    run = F.col("can_execute")
    records = gate.select(
        F.col("text").alias("request_text"), F.to_json(F.struct(*key)).alias("ir_json"), F.col("step_key").alias("statement"),
        F.to_json(F.array("step_key", F.col("step_order").cast("string"))).alias("params_json"), "sql_fingerprint",
        F.when(run, F.col("step_order")).otherwise(0).cast("long").alias("affected_row_count"),
        F.when(run, F.lit("executed")).otherwise(F.lit("skipped")).alias("status"),
        F.when(run, F.to_json(F.struct("step_order", F.col("preview_fingerprint").alias("preview")))).alias("rollback_json"),
        F.col("refused_by").alias("error_message"))
    path = _dir(spark, "exec_log")
    K.write_execution_log(records, path)
    return spark.read.parquet(path)


@register(
    "catalog_refresh_log",
    _VALUE_CATALOG_SQL + "SELECT 'refresh-1' AS refresh_id, 'completed' AS status, count(*) AS row_count, "
    "CAST(NULL AS VARCHAR) AS error_message FROM vc",
)
def catalog_refresh_log(spark, sf):
    cat = C.value_catalog(stg_k(spark, sf), "SA")
    return K.catalog_refresh_log(spark, cat, _dir(spark, "value_catalog"), _dir(spark, "refresh_log"), "refresh-1")
