"""Queries for linked step plans (L1-L9) over plans derived from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.plans import steps as L
from tabvet.queries.registry import register
from tabvet.sources.derived import PLAN_SQL, plan_steps


def _ext(spark, sf):
    """Plan steps with per-step conditions, group-by, metrics and actions."""
    s = plan_steps(spark, sf)
    t = F.col("step_order") - 1
    role_cond = F.concat(F.lit("len_bucket="), (F.floor(F.length("text") / 200) * 200).cast("long").cast("string"))
    turn_cond = F.concat(F.lit("turn_parity="), (t % 2).cast("string"))
    conds = (F.when(F.length("text") % 3 == 0, F.array().cast("array<string>"))
             .when(t % 2 == 0, F.array(role_cond, turn_cond)).otherwise(F.array(role_cond)))
    group_by = (F.when(t % 3 == 0, F.array(F.lit("campaign"), F.lit("device")))
                .when(t % 3 == 1, F.array(F.lit("device"), F.lit("campaign"))).otherwise(F.array(F.lit("day"))))
    metrics = (F.when(t % 2 == 0, F.array(F.lit("cost:sum"), F.lit("clicks:sum")))
               .when(t % 4 == 1, F.array(F.lit("clicks:sum"), F.lit("cost:sum"))).otherwise(F.array().cast("array<string>")))
    actions = F.when(F.col("intent_type") == "UPDATE_NUMERIC_VALUE", F.array(F.lit("set_zero:cost"))).otherwise(F.array().cast("array<string>"))
    return s.withColumns({
        "conditions": conds, "group_by": group_by, "metrics": metrics, "actions": actions,
        "has_derived": F.col("intent_type") == "ADD_DERIVED_COLUMN",
    })


EXT_SQL = PLAN_SQL + """,
ext AS (
  SELECT *, CASE WHEN length(text) % 3 = 0 THEN CAST([] AS VARCHAR[])
                 WHEN turn % 2 = 0 THEN ['len_bucket=' || CAST(CAST(floor(length(text) / 200) * 200 AS BIGINT) AS VARCHAR),
                                         'turn_parity=' || CAST(turn % 2 AS VARCHAR)]
                 ELSE ['len_bucket=' || CAST(CAST(floor(length(text) / 200) * 200 AS BIGINT) AS VARCHAR)] END AS conditions,
    CASE WHEN turn % 3 = 0 THEN ['campaign', 'device'] WHEN turn % 3 = 1 THEN ['device', 'campaign'] ELSE ['day'] END AS group_by,
    CASE WHEN turn % 2 = 0 THEN ['cost:sum', 'clicks:sum'] WHEN turn % 4 = 1 THEN ['clicks:sum', 'cost:sum']
         ELSE CAST([] AS VARCHAR[]) END AS metrics,
    CASE WHEN intent_type = 'UPDATE_NUMERIC_VALUE' THEN ['set_zero:cost'] ELSE CAST([] AS VARCHAR[]) END AS actions,
    intent_type = 'ADD_DERIVED_COLUMN' AS has_derived
  FROM plan_steps2)"""

ANC_SQL = """anc AS (
  SELECT plan_id, step_key, dep_key AS ancestor_key FROM edges
  UNION
  SELECT a.plan_id, a.step_key, e.dep_key FROM anc a JOIN edges e ON a.plan_id = e.plan_id AND a.ancestor_key = e.step_key)"""


def _closure(spark, sf):
    return L.transitive_closure(L.plan_edges(plan_steps(spark, sf)))


@register("step_ancestors", "WITH RECURSIVE " + PLAN_SQL + ",\n" + ANC_SQL + "\nSELECT DISTINCT plan_id, step_key, ancestor_key FROM anc")
def step_ancestors(spark, sf):
    return _closure(spark, sf)


@register(
    "steps_to_invalidate",
    "WITH RECURSIVE " + PLAN_SQL + ",\n" + ANC_SQL + """,
me AS (SELECT plan_id, min(step_order) AS my_order FROM plan_steps WHERE step_key = 's1' GROUP BY plan_id),
dep AS (SELECT plan_id, step_key FROM anc WHERE ancestor_key = 's1' UNION SELECT plan_id, 's1' FROM me),
ord AS (SELECT DISTINCT p.plan_id, p.step_key FROM plan_steps p JOIN me USING (plan_id) WHERE p.step_order >= me.my_order)
SELECT plan_id, step_key, 'dependents' AS mode FROM dep UNION ALL SELECT plan_id, step_key, 'order' AS mode FROM ord""",
)
def steps_to_invalidate(spark, sf):
    s = plan_steps(spark, sf)
    c = L.transitive_closure(L.plan_edges(s))
    a = L.steps_to_invalidate(c, s, "s1", "dependents").withColumn("mode", F.lit("dependents"))
    b = L.steps_to_invalidate(c, s, "s1", "order").withColumn("mode", F.lit("order"))
    return a.unionByName(b)


@register(
    "step_plan_validation",
    "WITH " + PLAN_SQL + """,
n AS (SELECT plan_id, count(*) AS n FROM plan_steps2 GROUP BY plan_id),
s AS (SELECT p.* FROM plan_steps2 p JOIN n USING (plan_id) WHERE n.n > 1),
dep AS (SELECT plan_id, step_order, step_key, unnest(depends_on) AS dep_key FROM s),
keys AS (SELECT plan_id, step_key AS dep_key, step_order AS dep_order FROM s),
firstpos AS (SELECT plan_id, dep_key, min(dep_order) AS first_order FROM keys GROUP BY plan_id, dep_key),
errs AS (
  SELECT plan_id, CAST(NULL AS INTEGER) AS step_order, step_key, 'linked_step_duplicate_id' AS error_code,
         CAST(NULL AS VARCHAR) AS detail, 'error' AS severity FROM s GROUP BY plan_id, step_key HAVING count(*) > 1
  UNION ALL SELECT plan_id, step_order, step_key, 'linked_step_self_dependency', NULL, 'error' FROM s WHERE list_contains(depends_on, step_key)
  UNION ALL SELECT d.plan_id, d.step_order, d.step_key, 'linked_step_missing_dependency', d.dep_key, 'error' FROM dep d
    WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.plan_id = d.plan_id AND k.dep_key = d.dep_key)
  UNION ALL SELECT d.plan_id, d.step_order, d.step_key, 'linked_step_dependency_order_violation', d.dep_key, 'error'
    FROM dep d JOIN firstpos f ON f.plan_id = d.plan_id AND f.dep_key = d.dep_key WHERE f.first_order >= d.step_order
  UNION ALL SELECT plan_id, step_order, step_key, 'linked_step_dependent_without_depends_on', NULL, 'error' FROM s
    WHERE dependency_type = 'dependent' AND len(depends_on) = 0
  UNION ALL SELECT plan_id, step_order, step_key, 'linked_step_independent_has_depends_on', NULL, 'warning' FROM s
    WHERE dependency_type = 'independent' AND len(depends_on) > 0)
SELECT DISTINCT * FROM errs""",
)
def step_plan_validation(spark, sf):
    return L.step_plan_validation(plan_steps(spark, sf))


@register(
    "step_availability",
    "WITH " + PLAN_SQL + """,
acc AS (SELECT DISTINCT plan_id, step_key AS dep_key FROM plan_steps WHERE step_status = 'accepted'),
dep AS (SELECT plan_id, step_order, unnest(depends_on) AS dep_key FROM plan_steps),
blocked AS (SELECT DISTINCT d.plan_id, d.step_order FROM dep d
            WHERE NOT EXISTS (SELECT 1 FROM acc a WHERE a.plan_id = d.plan_id AND a.dep_key = d.dep_key))
SELECT p.plan_id, p.step_order, p.step_key, (b.plan_id IS NULL AND p.step_status <> 'cancelled') AS available
FROM plan_steps p LEFT JOIN blocked b ON b.plan_id = p.plan_id AND b.step_order = p.step_order""",
)
def step_availability(spark, sf):
    return L.step_availability(plan_steps(spark, sf))


@register(
    "inherit_conditions",
    "WITH RECURSIVE " + EXT_SQL + ",\n" + ANC_SQL + """,
own AS (SELECT plan_id, step_order, step_key, unnest(conditions) AS condition FROM ext),
ac AS (SELECT DISTINCT plan_id, step_key AS ancestor_key, unnest(conditions) AS condition FROM ext),
inh AS (SELECT e.plan_id, e.step_order, e.step_key, ac.condition FROM ext e
        JOIN (SELECT DISTINCT * FROM anc) a ON a.plan_id = e.plan_id AND a.step_key = e.step_key
        JOIN ac ON ac.plan_id = a.plan_id AND ac.ancestor_key = a.ancestor_key)
SELECT DISTINCT * FROM (SELECT * FROM own UNION ALL SELECT * FROM inh)""",
)
def inherit_conditions(spark, sf):
    s = _ext(spark, sf)
    return L.inherit_conditions(s, L.transitive_closure(L.plan_edges(s)))


@register(
    "plan_counts",
    "WITH " + PLAN_SQL + """
SELECT plan_id, count(*) AS step_count, count(*) FILTER (WHERE dependency_type = 'dependent') AS dependent_step_count
FROM plan_steps2 GROUP BY plan_id""",
)
def plan_counts(spark, sf):
    return L.plan_counts(plan_steps(spark, sf))


_SIG = "array_to_string(list_sort(group_by), ',') || '|' || array_to_string(list_sort(metrics), ',')"


@register(
    "prune_duplicate_aggregates",
    "WITH " + EXT_SQL + f""",
s AS (SELECT *, {_SIG} AS sig FROM ext),
scoped AS (SELECT DISTINCT plan_id, sig FROM s WHERE intent_type = 'SELECT_AGGREGATE' AND len(metrics) > 0 AND len(conditions) > 0),
dropped AS (SELECT plan_id, step_order FROM s WHERE intent_type = 'SELECT_AGGREGATE' AND len(conditions) = 0
            AND EXISTS (SELECT 1 FROM scoped c WHERE c.plan_id = s.plan_id AND c.sig = s.sig))
SELECT plan_id, step_order, step_key, intent_type FROM s
WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.plan_id = s.plan_id AND d.step_order = s.step_order)""",
)
def prune_duplicate_aggregates(spark, sf):
    return L.prune_duplicate_aggregates(_ext(spark, sf)).select("plan_id", "step_order", "step_key", "intent_type")


# configured sequential wording for the multilingual test texts
SEQ_TERMS = ("et", "und")


@register(
    "infer_dependencies",
    "WITH " + PLAN_SQL + """,
w AS (SELECT *, last_value(CASE WHEN intent_type IN ('UPDATE_NUMERIC_VALUE', 'ADD_DERIVED_COLUMN') THEN step_key END IGNORE NULLS)
        OVER (PARTITION BY plan_id ORDER BY step_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_mut,
      count(*) OVER (PARTITION BY plan_id) AS n,
      first_value(text) OVER (PARTITION BY plan_id ORDER BY step_order) AS plan_text
      FROM plan_steps2),
w2 AS (SELECT *, (regexp_replace(lower(plan_text), '\\s+', '', 'g') LIKE '%et%'
                  OR regexp_replace(lower(plan_text), '\\s+', '', 'g') LIKE '%und%') AS hit FROM w),
a AS (SELECT *, (hit AND n > 1 AND intent_type IN ('SELECT_DETAIL', 'SELECT_AGGREGATE') AND len(depends_on) = 0
                 AND last_mut IS NOT NULL) AS applies FROM w2)
SELECT plan_id, step_order, step_key,
  array_to_string(CASE WHEN applies THEN [last_mut] ELSE depends_on END, ',') AS depends_on,
  CASE WHEN applies THEN 'dependent' ELSE dependency_type END AS dependency_type FROM a""",
)
def infer_dependencies(spark, sf):
    from pyspark.sql import Window

    # the wording is read from the plan's request (its first turn), as for a multi-step request
    s = plan_steps(spark, sf)
    s = s.withColumn("plan_text", F.first("text").over(Window.partitionBy("plan_id").orderBy("step_order")))
    out = L.infer_dependencies(s, "plan_text", SEQ_TERMS)
    return out.withColumn("depends_on", F.array_join("depends_on", ","))


@register(
    "split_mixed_steps",
    "WITH " + EXT_SQL + """,
m AS (SELECT *, len(metrics) > 0 AND (len(actions) > 0 OR has_derived) AS mixed FROM ext)
SELECT plan_id, step_order, step_key, CASE WHEN has_derived THEN 'ADD_DERIVED_COLUMN' ELSE 'UPDATE_NUMERIC_VALUE' END AS intent_type,
  array_to_string(actions, ',') AS actions, '' AS metrics, array_to_string(depends_on, ',') AS depends_on, 'mutate' AS part
FROM m WHERE mixed
UNION ALL SELECT plan_id, step_order, step_key || '_aggregate', 'SELECT_AGGREGATE', '', array_to_string(metrics, ','), step_key, 'aggregate'
FROM m WHERE mixed
UNION ALL SELECT plan_id, step_order, step_key, intent_type, array_to_string(actions, ','), array_to_string(metrics, ','),
  array_to_string(depends_on, ','), 'unchanged' FROM m WHERE NOT mixed""",
)
def split_mixed_steps(spark, sf):
    out = L.split_mixed_steps(_ext(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("actions", "metrics", "depends_on")})
