"""State tables the operators need, derived deterministically from the driver
tables (so their size grows with the data), in Spark and as oracle SQL.

* delta log: preview deltas of three steps over ``stg_b`` (orders)
* delta events: the append-only status log behind the delta items
* plan steps: one linked plan per conversation, one step per turn
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.session import materialize
from tabvet.sources.tables import STAGING_SQL, load, stg_b

AS_OF = dt.datetime(2024, 6, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-06-01 00:00:00'"

# fixed step DAG of the delta plan: step -> (order, depends_on); s4 is the reader
DELTA_STEPS = {"s1": (1, []), "s2": (2, ["s1"]), "s3": (2, []), "s4": (3, ["s2"])}
CURRENT_STEP = "s4"


def _status(k: Column) -> Column:
    return F.when(k % 35 == 0, F.lit("pending")).when(k % 55 == 0, F.lit("cancelled")).otherwise(F.lit("approved"))


def delta_items(spark: SparkSession, sf_dir: str, as_of: dt.datetime = AS_OF) -> DataFrame:
    """One row per (source row, step): before/after maps of the changed columns."""
    b = stg_b(spark, sf_dir)
    k = F.col("row_id")
    ts = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    expires = _expires(k, ts)

    def step(key: str, order: int, idx: int, cond: Column, before: dict, after: dict, target: str = "SA") -> DataFrame:
        return b.where(cond).select(
            (k * 10 + idx).alias("delta_item_id"),
            F.lit("p1").alias("linked_plan_id"),
            F.lit(key).alias("step_key"),
            F.lit(order).alias("step_order"),
            F.lit(target).alias("target_table"),
            k.alias("source_row_id"),
            F.lit("preview_update").alias("delta_type"),
            F.create_map(*[x for c, v in before.items() for x in (F.lit(c), v)]).alias("before"),
            F.create_map(*[x for c, v in after.items() for x in (F.lit(c), v)]).alias("after"),
            _status(k).alias("delta_status"),
            expires.alias("expires_at"),
        )

    s1 = step("s1", 1, 1, k % 5 == 0, {"cost": F.col("cost"), "sessions": F.col("sessions")},
              {"cost": F.lit("0"), "sessions": F.lit("0")})
    s2 = step("s2", 2, 2, k % 10 == 0, {"cost": F.col("cost")},
              {"cost": F.when(k % 30 == 0, F.lit(None).cast("string")).otherwise(F.lit("100.00"))})
    s3 = step("s3", 2, 3, k % 3 == 0, {"cost": F.col("cost")}, {"cost": F.lit("7")})
    # another table whose rows have the same ids
    other = step("s2", 2, 6, k % 4 == 0, {"cost": F.col("cost")}, {"cost": F.lit("999")}, target="DA")
    return s1.unionByName(s2).unionByName(s3).unionByName(other)


def _expires(k: Column, ts: Column) -> Column:
    """Some deltas have expired, some never expire."""
    return (F.when(k % 65 == 0, ts - F.expr("INTERVAL 1 HOUR")).when(k % 25 == 0, F.lit(None).cast("timestamp_ntz"))
            .otherwise(ts + F.expr("INTERVAL 23 HOURS")))


_EXPIRES_SQL = (f"CASE WHEN source_row_id % 65 = 0 THEN {AS_OF_SQL} - INTERVAL 1 HOUR WHEN source_row_id % 25 = 0 THEN NULL"
                f" ELSE {AS_OF_SQL} + INTERVAL 23 HOUR END AS expires_at")
_STATUS_SQL = "CASE WHEN source_row_id % 35 = 0 THEN 'pending' WHEN source_row_id % 55 = 0 THEN 'cancelled' ELSE 'approved' END AS delta_status"
#: Approved and unexpired at the fixed clock.
LIVE_SQL = f"delta_status = 'approved' AND (expires_at IS NULL OR expires_at > {AS_OF_SQL})"


DELTA_SQL = STAGING_SQL["stg_b"] + f""",
delta_long AS (
  SELECT row_id * 10 + 1 AS delta_item_id, 's1' AS step_key, 1 AS step_order, row_id AS source_row_id, 'cost' AS column_name,
         cost AS old_value, '0' AS new_value, 'SA' AS target_table FROM stg_b WHERE row_id % 5 = 0
  UNION ALL SELECT row_id * 10 + 1, 's1', 1, row_id, 'sessions', sessions, '0', 'SA' FROM stg_b WHERE row_id % 5 = 0
  UNION ALL SELECT row_id * 10 + 2, 's2', 2, row_id, 'cost', cost, CASE WHEN row_id % 30 = 0 THEN NULL ELSE '100.00' END, 'SA'
    FROM stg_b WHERE row_id % 10 = 0
  UNION ALL SELECT row_id * 10 + 3, 's3', 2, row_id, 'cost', cost, '7', 'SA' FROM stg_b WHERE row_id % 3 = 0
  UNION ALL SELECT row_id * 10 + 6, 's2', 2, row_id, 'cost', cost, '999', 'DA' FROM stg_b WHERE row_id % 4 = 0),
delta AS (SELECT *, {_STATUS_SQL}, {_EXPIRES_SQL} FROM delta_long)"""


# ---------------------------------------------------------------- derived labels
#: (item digit, plan, table, step, order, key, label, condition on cost, row arithmetic): labels that earlier steps
#: gave to rows; only those of plan p1, table SA and an ancestor step of s4 are in its scope.
DERIVED_LABELS = (
    (1, "p1", "SA", "s1", 1, "price_band", "high", "cost > 200000", 1),
    (2, "p1", "SA", "s2", 2, "price_band", "top", "cost > 200000", 2),
    (3, "p1", "DA", "s1", 1, "price_band", "high", "cost <= 200000", 9),
    (4, "p2", "SA", "s1", 1, "price_band", "high", "cost <= 200000", 8),
    (5, "p1", "SA", "s4", 3, "price_band", "high", "cost <= 200000", 6),
    (6, "p1", "SA", "s3", 2, "price_band", "high", "cost <= 200000", 4),
    (7, "p1", "SA", "s1", 1, "tier", "small", "cost < 50000", 1),
)


def derived_labels(spark: SparkSession, sf_dir: str, cost: Column, as_of: dt.datetime = AS_OF) -> DataFrame:
    """Derived deltas (one label each) over ``stg_b``; ``cost`` is its numeric cost."""
    b, k = stg_b(spark, sf_dir).withColumn("_cost", cost), F.col("row_id")
    ts = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    parts = [
        b.where(F.expr(rule.replace("cost", "_cost")) & (k % every == 0)).select(
            (k * 10 + digit).alias("delta_item_id"), F.lit(plan).alias("linked_plan_id"), F.lit(table).alias("target_table"),
            F.lit(step).alias("step_key"), F.lit(order).alias("step_order"), k.alias("source_row_id"),
            F.create_map(F.lit(key), F.lit(label)).alias("after"), _status(k).alias("delta_status"), _expires(k, ts).alias("expires_at"))
        for digit, plan, table, step, order, key, label, rule, every in DERIVED_LABELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def derived_labels_sql(cost: str) -> str:
    """The same as a CTE list (``derived``) behind the staging views."""
    long = "\n  UNION ALL ".join(
        f"SELECT row_id * 10 + {digit} AS delta_item_id, '{plan}' AS linked_plan_id, '{table}' AS target_table, '{step}' AS step_key,"
        f" {order} AS step_order, row_id AS source_row_id, '{key}' AS label_key, '{label}' AS label"
        f" FROM stg_b WHERE {rule.replace('cost', cost)} AND row_id % {every} = 0"
        for digit, plan, table, step, order, key, label, rule, every in DERIVED_LABELS)
    return STAGING_SQL["stg_b"] + f""",
derived AS (SELECT *, {_STATUS_SQL}, {_EXPIRES_SQL} FROM (
  {long}))"""


def delta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only status log: every item is created 'pending' (seq 1); approved
    and cancelled items get a second event; pending items of step s1 are
    re-previewed: the old item is 'replaced' and a new pending item appears."""
    d = delta_items(spark, sf_dir).select("delta_item_id", "linked_plan_id", "step_key", "source_row_id", "delta_status", "expires_at")
    k = F.col("source_row_id")
    created = d.select("delta_item_id", "linked_plan_id", "step_key", "source_row_id", F.lit(1).alias("seq"),
                       F.lit("pending").alias("status"), "expires_at")
    moved = d.where(F.col("delta_status") != "pending").select(
        "delta_item_id", "linked_plan_id", "step_key", "source_row_id", F.lit(2).alias("seq"), F.col("delta_status").alias("status"), "expires_at")
    repl_src = d.where((F.col("delta_status") == "pending") & (F.col("step_key") == "s1"))
    replaced = repl_src.select("delta_item_id", "linked_plan_id", "step_key", "source_row_id", F.lit(3).alias("seq"),
                               F.lit("replaced").alias("status"), "expires_at")
    fresh = repl_src.select((k * 10 + 5).alias("delta_item_id"), "linked_plan_id", "step_key", "source_row_id",
                            F.lit(1).alias("seq"), F.lit("pending").alias("status"), "expires_at")
    return created.unionByName(moved).unionByName(replaced).unionByName(fresh)


EVENTS_SQL = DELTA_SQL + """,
items AS (SELECT DISTINCT delta_item_id, step_key, source_row_id, delta_status, expires_at FROM delta),
events AS (
  SELECT delta_item_id, step_key, source_row_id, 1 AS seq, 'pending' AS status, expires_at FROM items
  UNION ALL SELECT delta_item_id, step_key, source_row_id, 2, delta_status, expires_at FROM items WHERE delta_status <> 'pending'
  UNION ALL SELECT delta_item_id, step_key, source_row_id, 3, 'replaced', expires_at FROM items
    WHERE delta_status = 'pending' AND step_key = 's1'
  UNION ALL SELECT source_row_id * 10 + 5, step_key, source_row_id, 1, 'pending', expires_at FROM items
    WHERE delta_status = 'pending' AND step_key = 's1')"""


# ---------------------------------------------------------------- plan steps
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One linked plan per conversation, one step per turn, with a chain, a
    diamond, self/missing/out-of-order dependencies and duplicate ids."""
    c = load(spark, sf_dir, "conversations")
    t = F.col("turn")
    p = F.col("conv_id")

    def s(x: Column) -> Column:
        return F.concat(F.lit("s"), x.cast("string"))

    deps = (
        F.when((p % 11 == 0) & (t == 1), F.array(F.lit("s1")))
        .when((p % 19 == 0) & (t == 1), F.array(F.lit("s2")))
        .when(t == 0, F.array().cast("array<string>"))
        .when(t % 2 == 1, F.array(s(t - 1)))
        .otherwise(F.array(s(t - 2), s(t - 1)))
    )
    deps = F.when((p % 13 == 0) & (t == 2), F.array_append(deps, F.lit("s99"))).otherwise(deps)
    key = F.when((p % 17 == 0) & (t == 1), F.lit("s0")).otherwise(s(t))
    intent = (
        F.when(t % 5 == 4, F.lit("ADD_DERIVED_COLUMN"))
        .when(F.col("role") == "user", F.lit("UPDATE_NUMERIC_VALUE"))
        .otherwise(F.lit("SELECT_AGGREGATE"))
    )
    dep_type = F.when((p % 23 == 0) & (t == 0), F.lit("dependent")).when(F.size(deps) > 0, F.lit("dependent")).otherwise(F.lit("independent"))
    n = F.length("text")
    status = F.when(n % 5 == 0, F.lit("cancelled")).when(n % 5 <= 2, F.lit("accepted")).otherwise(F.lit("pending"))
    return c.select(
        p.alias("plan_id"), key.alias("step_key"), (t + 1).cast("int").alias("step_order"), intent.alias("intent_type"),
        dep_type.alias("dependency_type"), deps.alias("depends_on"), status.alias("step_status"), F.col("text"),
    )


# ---------------------------------------------------------------- import rows
# payload header -> SQL over stg_m's columns (fixed header spellings of the synthetic files); members of the dimensions
# stand there with a name, a code, both or neither
IMPORT_HEADERS = {
    "일자": "date_cell", "보고 시작": "start_cell", "캠페인": "campaign", "세션 캠페인": "session_campaign",
    "광고 소재 이름": "creative", "세션 수동 광고 콘텐츠": "ad_content", "기기": "device_cell", "노출": "num_cell",
    "클릭수": "clicks_cell", "비용": "num_cell", "세션수": "clicks_cell", "비고": "ad_content",
    "캠페인 ID": "CASE WHEN row_id % 4 = 1 THEN 'c' || CAST(row_id % 7 AS STRING) ELSE '' END",
    "광고그룹": "CASE WHEN row_id % 5 = 0 THEN '' ELSE 'ag-' || CAST(row_id % 12 AS STRING) END",
    "광고 그룹 ID": "CASE WHEN row_id % 3 = 0 THEN 'g' || CAST(row_id % 12 AS STRING) ELSE ' ' END",
    "광고 소재 ID": "CASE WHEN row_id % 6 = 2 THEN 'k' || CAST(row_id % 9 AS STRING) END",
    "이벤트 이름": "CASE row_id % 6 WHEN 0 THEN 'purchase' WHEN 1 THEN 'page_view' WHEN 2 THEN '회원 가입완료' WHEN 3 THEN 'Form_Complete' WHEN 4 THEN ' ' END",
}
FOLDERS = {"1-URGENT": "DA_display", "2-HIGH": "DA_display", "3-MEDIUM": "SA_search", "4-NOT SPECIFIED": "GA_web", "5-LOW": "GA_web"}


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of synthetic export files: file path + payload map<header, cell>."""
    from tabvet.sources.tables import stg_m

    m = stg_m(spark, sf_dir)
    folder = None
    for ch, f in FOLDERS.items():
        cond = F.col("source_channel") == ch
        folder = F.when(cond, F.lit(f)) if folder is None else folder.when(cond, F.lit(f))
    k = F.col("row_id")
    suffix = F.when(k % 3 == 0, F.lit("_20240105")).when(k % 3 == 1, F.lit("_organic")).otherwise(F.lit("_BSA"))
    name = F.concat(F.lower(F.regexp_replace("source_channel", " ", "_")), suffix, F.lit(".csv"))
    path = F.concat(F.lit("raw/"), folder, F.lit("/"), name)
    payload = F.create_map(*[x for h, c in IMPORT_HEADERS.items() for x in (F.lit(h), F.expr(c))])
    rows = m.select("row_id", path.alias("file_path"), payload.alias("payload"))
    # Materialised like a file read: without this, the optimizer folds every
    # later map lookup back into the synthetic CASE expressions above.
    return materialize(rows, "import_rows")


IMPORT_SQL = STAGING_SQL["stg_m"] + ",\nimport_rows AS (\n  SELECT row_id, 'raw/' || CASE source_channel " + " ".join(
    f"WHEN '{ch}' THEN '{f}'" for ch, f in FOLDERS.items()
) + """ END || '/' || lower(replace(source_channel, ' ', '_'))
    || CASE WHEN row_id % 3 = 0 THEN '_20240105' WHEN row_id % 3 = 1 THEN '_organic' ELSE '_BSA' END || '.csv' AS file_path,
    MAP {""" + ", ".join(f"'{h}': {c}" for h, c in IMPORT_HEADERS.items()) + """} AS payload, * EXCLUDE (row_id)
  FROM stg_m)"""


PLAN_SQL = """plan_steps AS (
  SELECT conv_id AS plan_id,
    CASE WHEN conv_id % 17 = 0 AND turn = 1 THEN 's0' ELSE 's' || CAST(turn AS VARCHAR) END AS step_key,
    CAST(turn + 1 AS INTEGER) AS step_order,
    CASE WHEN turn % 5 = 4 THEN 'ADD_DERIVED_COLUMN' WHEN role = 'user' THEN 'UPDATE_NUMERIC_VALUE' ELSE 'SELECT_AGGREGATE' END AS intent_type,
    CASE WHEN conv_id % 13 = 0 AND turn = 2 THEN list_append(d0, 's99') ELSE d0 END AS depends_on,
    CASE WHEN length(text) % 5 = 0 THEN 'cancelled' WHEN length(text) % 5 <= 2 THEN 'accepted' ELSE 'pending' END AS step_status,
    conv_id, turn, text
  FROM (SELECT *, CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN ['s1']
                       WHEN conv_id % 19 = 0 AND turn = 1 THEN ['s2']
                       WHEN turn = 0 THEN CAST([] AS VARCHAR[])
                       WHEN turn % 2 = 1 THEN ['s' || CAST(turn - 1 AS VARCHAR)]
                       ELSE ['s' || CAST(turn - 2 AS VARCHAR), 's' || CAST(turn - 1 AS VARCHAR)] END AS d0
        FROM conversations)),
plan_steps2 AS (
  SELECT *, CASE WHEN conv_id % 23 = 0 AND turn = 0 THEN 'dependent' WHEN len(depends_on) > 0 THEN 'dependent'
                 ELSE 'independent' END AS dependency_type FROM plan_steps),
edges AS (SELECT DISTINCT plan_id, step_key, unnest(depends_on) AS dep_key FROM plan_steps)"""
