"""Queries for quality checks and evaluation reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabvet.operators import quality as Q
from tabvet.plans import steps as L
from tabvet.queries.q_projections import _parse_number_sql
from tabvet.queries.registry import register
from tabvet.session import shared_path
from tabvet.sources.derived import DELTA_SQL, PLAN_SQL, delta_items, plan_steps
from tabvet.sources.tables import TABLES, load, stg_k, with_staging


def _results(spark, sf):
    c = load(spark, sf, "conversations")
    n = F.length("text")
    s = c.select(
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("test")).otherwise(F.lit("test2")).alias("suite"),
        F.col("turn").alias("run"), F.col("conv_id").alias("case_no"),
        F.when(n % 11 == 0, 1).otherwise(0).alias("error_count"),
        F.when(n % 7 == 0, F.lit("failed")).otherwise(F.lit("passed")).alias("validation_status"),
        F.when(F.col("turn") % 5 == 3, F.lit("executed")).otherwise(F.lit("pending_user_confirmation")).alias("preview_status"),
        (n % 26).alias("affected_row_count"),
        F.when(n % 13 == 0, 0).otherwise(2).alias("previewed_row_count"),
        (n % 17 != 0).alias("has_sql"),
        F.when(n % 19 == 0, 1).otherwise(0).alias("semantic_error_count"),
        F.when(F.col("role") == "system", F.lit("not_evaluated")).when(n % 5 == 0, F.lit("pending"))
        .when(n % 3 == 0, F.lit("failed")).otherwise(F.lit("passed")).alias("semantic_status"),
    )
    return s.withColumn("status", Q.result_status(s))


RESULTS_SQL = """WITH r0 AS (
  SELECT 'm' || CAST(conv_id % 3 AS VARCHAR) AS model, CASE WHEN conv_id % 2 = 0 THEN 'test' ELSE 'test2' END AS suite,
    turn AS run, conv_id AS case_no, CASE WHEN length(text) % 11 = 0 THEN 1 ELSE 0 END AS error_count,
    CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'passed' END AS validation_status,
    CASE WHEN turn % 5 = 3 THEN 'executed' ELSE 'pending_user_confirmation' END AS preview_status,
    length(text) % 26 AS affected_row_count, CASE WHEN length(text) % 13 = 0 THEN 0 ELSE 2 END AS previewed_row_count,
    length(text) % 17 <> 0 AS has_sql, CASE WHEN length(text) % 19 = 0 THEN 1 ELSE 0 END AS semantic_error_count,
    CASE WHEN role = 'system' THEN 'not_evaluated' WHEN length(text) % 5 = 0 THEN 'pending' WHEN length(text) % 3 = 0 THEN 'failed'
         ELSE 'passed' END AS semantic_status
  FROM conversations),
r1 AS (SELECT *, CASE WHEN NOT has_sql THEN 'CHECK' WHEN error_count > 0 THEN 'CHECK'
          WHEN validation_status = 'passed' AND preview_status = 'pending_user_confirmation' THEN 'PASS' ELSE 'ERROR' END AS s1 FROM r0),
r2 AS (SELECT *, CASE WHEN s1 = 'PASS' AND previewed_row_count <= 0 AND NOT (validation_status = 'passed'
          AND preview_status = 'pending_user_confirmation' AND affected_row_count = 0 AND previewed_row_count = 0) THEN 'CHECK'
          ELSE s1 END AS s2 FROM r1),
results AS (SELECT *, CASE WHEN s2 = 'PASS' AND semantic_error_count > 0 THEN 'CHECK' ELSE s2 END AS status FROM r2),
metrics AS (SELECT model, suite, run, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS pass_count,
    count(*) FILTER (WHERE semantic_status = 'passed') AS semantic_pass_count,
    count(*) FILTER (WHERE semantic_status = 'failed') AS semantic_fail_count,
    count(*) FILTER (WHERE (semantic_status IN ('pending', 'not_evaluated') OR regexp_matches(semantic_status, '^[a-z]+_review_required$'))) AS semantic_pending_count
  FROM results GROUP BY model, suite, run),
m2 AS (SELECT *,
    CASE WHEN total > 0 THEN CAST((2 * CAST(pass_count AS HUGEINT) * 100000000 + total) // (2 * total) AS DOUBLE) / 1000000.0
         ELSE 0.0 END AS pass_rate,
    CASE WHEN total > 0 THEN CAST((2 * CAST(semantic_pass_count AS HUGEINT) * 100000000 + total) // (2 * total) AS DOUBLE) / 1000000.0
         ELSE 0.0 END AS semantic_pass_rate FROM metrics)
"""


def _metrics(spark, sf):
    return Q.suite_metrics(_results(spark, sf), ["model", "suite", "run"])


def _avg6(c: str) -> str:
    """Exact mean of 6-decimal values, rounded half-up to 6 decimals."""
    q = f"CAST(round({c} * 1000000) AS HUGEINT)"
    return f"CAST((2 * sum({q}) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000.0"


@register("result_status", RESULTS_SQL + "SELECT case_no, run, status FROM results")
def result_status(spark, sf):
    return _results(spark, sf).select("case_no", "run", "status")


@register("suite_metrics", RESULTS_SQL + "SELECT * FROM m2")
def suite_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.withColumns({c: F.col(c).cast("double") for c in ("pass_rate", "semantic_pass_rate")})


@register(
    "model_suite_summary",
    RESULTS_SQL + f"""SELECT model, suite, count(*) AS runs, {_avg6('pass_rate')} AS pass_rate,
  {_avg6('semantic_pass_rate')} AS semantic_pass_rate FROM m2 GROUP BY model, suite""",
)
def model_suite_summary(spark, sf):
    return Q.model_suite_summary(_metrics(spark, sf))


@register(
    "review_completeness",
    RESULTS_SQL + """SELECT model, suite, run, semantic_pending_count, semantic_pass_count + semantic_fail_count AS reviewed_count, total
FROM m2 WHERE semantic_pending_count > 0 OR semantic_pass_count + semantic_fail_count <> total""",
)
def review_completeness(spark, sf):
    return Q.review_completeness(_metrics(spark, sf))


# streak parameters for the synthetic runs (defaults are 90 % and 10 cycles)
STREAK_THRESHOLD = 75.0
STREAK_REQUIRED = 2


@register(
    "pass_streaks",
    RESULTS_SQL + f""", cyc AS (SELECT model, run, {_avg6('pass_rate')} AS pass_average FROM m2 GROUP BY model, run),
c1 AS (SELECT *, pass_average > {STREAK_THRESHOLD} AS passed FROM cyc),
c2 AS (SELECT *, sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM c1),
c3 AS (SELECT *, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY model, g ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS streak FROM c2)
SELECT model, run, pass_average, passed, streak, streak >= {STREAK_REQUIRED} AS reached FROM c3""",
)
def pass_streaks(spark, sf):
    return Q.pass_streaks(_metrics(spark, sf), STREAK_THRESHOLD, STREAK_REQUIRED)


@register(
    "parse_report_lines",
    RESULTS_SQL + """SELECT model, suite, CAST(run AS BIGINT) AS run, count(*) AS total,
  count(*) FILTER (WHERE status = 'PASS') AS pass_count,
  count(*) FILTER (WHERE semantic_status = 'passed') AS semantic_pass_count,
  count(*) FILTER (WHERE semantic_status = 'failed') AS semantic_fail_count,
  count(*) FILTER (WHERE (semantic_status IN ('pending', 'not_evaluated') OR regexp_matches(semantic_status, '^[a-z]+_review_required$'))) AS semantic_pending_count,
  count(*) AS step_count,
  count(*) FILTER (WHERE (semantic_status IN ('pending', 'not_evaluated') OR regexp_matches(semantic_status, '^[a-z]+_review_required$'))) AS step_semantic_pending_count,
  count(*) FILTER (WHERE semantic_status IN ('passed', 'failed')) AS step_semantic_reviewed_count
FROM results GROUP BY model, suite, run""",
)
def parse_report_lines(spark, sf):
    r = _results(spark, sf)
    keys = ["model", "suite", "run"]
    case = F.col("case_no").cast("string")
    table_row = F.concat(F.lit("| "), case, F.lit(" | cat"), (F.col("case_no") % 4).cast("string"), F.lit(" | "), "status", F.lit(" |"))
    semantic = F.concat(F.lit("**Semantic**: "), "semantic_status", F.lit(" / note= / errors="))
    step = F.concat(F.lit("### 요청 묶음 s"), case)
    step_sem = F.concat(F.lit("**Step Semantic**: "), "semantic_status", F.lit(" / note= / errors="))
    lines = r.select(*keys, F.explode(F.array(table_row, semantic, step, step_sem)).alias("value"))
    heading = r.select(*keys, F.lit("# 테스트 결과").alias("value")).dropDuplicates(keys)
    # one markdown report per (model, suite, run), written to the shared folder and read back
    path = shared_path(spark, "reports", uuid.uuid4().hex)
    lines.unionByName(heading).write.partitionBy(*keys).text(path)
    back = spark.read.text(path).withColumn("run", F.col("run").cast("long"))
    return Q.parse_report_lines(back, keys)


@register(
    "layer_row_counts",
    "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
)
def layer_row_counts(spark, sf):
    return Q.layer_row_counts({t: load(spark, sf, t) for t in TABLES})


@register(
    "multistep_rollup",
    RESULTS_SQL + "," + PLAN_SQL + """,
n AS (SELECT plan_id, count(*) AS n FROM plan_steps2 GROUP BY plan_id),
s AS (SELECT p.* FROM plan_steps2 p JOIN n USING (plan_id) WHERE n.n > 1),
dep AS (SELECT plan_id, step_order, step_key, unnest(depends_on) AS dep_key FROM s),
firstpos AS (SELECT plan_id, step_key AS dep_key, min(step_order) AS first_order FROM s GROUP BY plan_id, step_key),
errs AS (SELECT DISTINCT plan_id, error_code FROM (
  SELECT plan_id, 'linked_step_duplicate_id' AS error_code FROM s GROUP BY plan_id, step_key HAVING count(*) > 1
  UNION ALL SELECT plan_id, 'linked_step_self_dependency' FROM s WHERE list_contains(depends_on, step_key)
  UNION ALL SELECT d.plan_id, 'linked_step_missing_dependency' FROM dep d LEFT JOIN firstpos f USING (plan_id, dep_key) WHERE f.dep_key IS NULL
  UNION ALL SELECT plan_id, 'linked_step_dependency_order_violation' FROM dep JOIN firstpos USING (plan_id, dep_key) WHERE first_order >= step_order
  UNION ALL SELECT plan_id, 'linked_step_dependent_without_depends_on' FROM s WHERE dependency_type = 'dependent' AND len(depends_on) = 0
  UNION ALL SELECT plan_id, 'linked_step_independent_has_depends_on' FROM s WHERE dependency_type = 'independent' AND len(depends_on) > 0)),
g AS (SELECT r.case_no AS plan_id, bool_and(r.status = 'PASS') AS passed, count(*) AS step_count,
        CAST(sum(r.affected_row_count) AS BIGINT) AS affected_row_count FROM results r GROUP BY r.case_no),
e AS (SELECT plan_id, array_to_string(list_sort(list(error_code)), ',') AS errors FROM errs GROUP BY plan_id)
SELECT g.plan_id, g.passed, g.step_count, g.affected_row_count, e.errors FROM g LEFT JOIN e ON e.plan_id = g.plan_id""",
)
def multistep_rollup(spark, sf):
    r = _results(spark, sf).select(F.col("case_no").alias("plan_id"), "status", "affected_row_count")
    errs = L.step_plan_validation(plan_steps(spark, sf)).select("plan_id", "error_code").distinct()
    return Q.multistep_rollup(r, errs)


ROW_CHECKS = [("세션수", "gt_zero"), ("비용", "gt_zero"), ("캠페인", "not_empty"), ("광고 그룹", "empty"), ("세션수", "zero_or_empty")]


def _sat_sql(c: str, op: str) -> str:
    v = f'CAST("{c}" AS VARCHAR)'
    empty = f"trim(COALESCE({v}, '')) = ''"
    n = _parse_number_sql(v)
    return {
        "gt_zero": f"({n} IS NOT NULL AND {n} > 0)",
        "zero_or_empty": f"({empty} OR COALESCE({n} = 0, FALSE))",
        "empty": f"({empty})",
        "not_empty": f"(NOT {empty})",
    }[op]


@register(
    "check_row_conditions",
    with_staging("stg_k") + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{op}' AS operator, count(*) AS checked_rows, "
        f"count(*) FILTER (WHERE NOT {_sat_sql(c, op)}) AS violations FROM stg_k" for c, op in ROW_CHECKS),
)
def check_row_conditions(spark, sf):
    return Q.check_row_conditions(stg_k(spark, sf), ROW_CHECKS)


@register(
    "check_update_after",
    "WITH " + DELTA_SQL + f""",
g AS (SELECT delta_item_id, list_distinct(list(column_name)) AS cols,
        bool_and(CASE WHEN column_name = 'cost' THEN COALESCE({_parse_number_sql('new_value')} = 0, FALSE) END) AS z
      FROM delta GROUP BY delta_item_id)
SELECT delta_item_id, list_contains(cols, 'cost') AS covers_targets, COALESCE(z, FALSE) AS after_zero,
  list_contains(cols, 'cost') AND COALESCE(z, FALSE) AS passed FROM g""",
)
def check_update_after(spark, sf):
    d = delta_items(spark, sf).select("delta_item_id", F.explode("after").alias("column_name", "new_value"))
    return Q.check_update_after(d, "delta_item_id", ["cost"])
