"""Queries for joins (J1-J3, J7, J11), window/sort/top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions.headers import strip_ws
from tabvet.operators import catalog as C
from tabvet.operators import joins as J
from tabvet.operators import overlay as OV
from tabvet.queries.q_plans import EXT_SQL, _ext
from tabvet.queries.registry import register
from tabvet.sources.tables import header_cells, load, stg_a, stg_b, stg_e, with_staging

# ------------------------------------------------------------------ J1
INACTIVE_MAPPINGS = ("기간",)
INACTIVE_FIELDS = ("landing_url", "session_term")
_MAP_VALUES = ", ".join(f"('{h}', '{c}', {str(h not in INACTIVE_MAPPINGS).upper()})" for h, c in FV.SOURCE_FIELD_CODES)
_STD_VALUES = ", ".join(
    f"('{c}', {str(c not in INACTIVE_FIELDS).upper()})" for c in dict.fromkeys(c for _, c in FV.SOURCE_FIELD_CODES))


@register(
    "field_mapping_join",
    with_staging("header_cells")
    + f""", m(source_field, field_code, active) AS (VALUES {_MAP_VALUES}),
s(field_code, active) AS (VALUES {_STD_VALUES}),
c AS (SELECT file_id, pos, regexp_replace(raw_header, '^\\s+|\\s+$', '', 'g') AS source_field FROM header_cells)
SELECT c.file_id, c.pos, c.source_field, m.field_code FROM c JOIN m ON m.source_field = c.source_field AND m.active
JOIN s ON s.field_code = m.field_code AND s.active""",
)
def field_mapping_join(spark, sf):
    cells = header_cells(spark, sf).select("file_id", "pos", strip_ws("raw_header").alias("source_field"))
    mapping = spark.createDataFrame([(h, c, h not in INACTIVE_MAPPINGS) for h, c in FV.SOURCE_FIELD_CODES],
                                    "source_field string, field_code string, active boolean")
    std = spark.createDataFrame([(c, c not in INACTIVE_FIELDS) for c in dict.fromkeys(c for _, c in FV.SOURCE_FIELD_CODES)],
                                "field_code string, active boolean")
    return J.field_mapping_join(cells, mapping, std).select("file_id", "pos", "source_field", "field_code")


# ------------------------------------------------------------------ J2 / J3
@register(
    "source_file_summary",
    """WITH li AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS ad_rows,
                    count(*) FILTER (WHERE l_returnflag = 'R') AS ga_rows FROM lineitem GROUP BY l_orderkey),
per AS (SELECT o.o_custkey, count(*) AS raw_rows, count(*) FILTER (WHERE o.o_orderstatus = 'F') AS parsed_rows,
          CAST(COALESCE(sum(li.ad_rows), 0) AS BIGINT) AS ad_fact_rows, CAST(COALESCE(sum(li.ga_rows), 0) AS BIGINT) AS ga_fact_rows
        FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey GROUP BY o.o_custkey)
SELECT c.c_custkey AS file_id, c.c_name AS file_name, n.n_name AS media_name,
  COALESCE(per.raw_rows, 0) AS raw_rows, COALESCE(per.parsed_rows, 0) AS parsed_rows,
  COALESCE(per.ad_fact_rows, 0) AS ad_fact_rows, COALESCE(per.ga_fact_rows, 0) AS ga_fact_rows
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN per ON per.o_custkey = c.c_custkey""",
)
def source_file_summary(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("ad_rows"), F.count_if(F.col("l_returnflag") == "R").alias("ga_rows"))
    o = load(spark, sf, "orders")
    # facts are pre-aggregated per order before joining: no fan-out
    per = o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("parsed_rows"),
        F.coalesce(F.sum("ad_rows"), F.lit(0)).cast("long").alias("ad_fact_rows"),
        F.coalesce(F.sum("ga_rows"), F.lit(0)).cast("long").alias("ga_fact_rows"))
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(per, c.c_custkey == per.o_custkey, "left")
    return j.select(
        F.col("c_custkey").alias("file_id"), F.col("c_name").alias("file_name"), F.col("n_name").alias("media_name"),
        *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("raw_rows", "parsed_rows", "ad_fact_rows", "ga_fact_rows")])


@register(
    "file_listing",
    """SELECT c.c_custkey AS file_id, c.c_name AS file_name, n.n_name AS media_name
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey ORDER BY c.c_custkey""",
)
def file_listing(spark, sf):
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("file_id"), F.col("c_name").alias("file_name"), F.col("n_name").alias("media_name")
    ).orderBy("file_id")


@register(
    "raw_sample",
    """SELECT o.o_orderkey AS row_id, c.c_name AS file_name, o.o_totalprice AS total
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey LIMIT 20""",
)
def raw_sample(spark, sf):
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), F.col("c_name").alias("file_name"), F.col("o_totalprice").alias("total")
    ).orderBy("row_id").limit(20)


# ------------------------------------------------------------------ J7
def _rules_and_requests(spark, sf):
    s = _ext(spark, sf)
    t = F.col("step_order") - 1
    n = F.length("text")
    requests = s.select("plan_id", "step_order", F.concat(F.lit("c"), (F.col("plan_id") % 5).cast("string")).alias("customer"),
                        F.col("conditions").alias("expected"))
    rules = s.select(
        (F.col("plan_id") * 10 + F.col("step_order")).alias("rule_id"),
        F.concat(F.lit("c"), ((F.col("plan_id") + 1) % 5).cast("string")).alias("customer"),
        (t % 4 != 3).alias("active"),
        F.when(n % 6 == 0, F.lit("pending")).otherwise(F.lit("approved")).alias("validation_status"),
        F.array_union("conditions", F.array(F.concat(F.lit("extra="), (F.col("plan_id") % 3).cast("string")))).alias("signatures"))
    return requests, rules


@register(
    "rule_subset_match",
    "WITH " + EXT_SQL + """,
req AS (SELECT plan_id, step_order, 'c' || CAST(plan_id % 5 AS VARCHAR) AS customer, conditions AS expected FROM ext),
rules AS (SELECT plan_id * 10 + step_order AS rule_id, 'c' || CAST((plan_id + 1) % 5 AS VARCHAR) AS customer,
                 turn % 4 <> 3 AS active, CASE WHEN length(text) % 6 = 0 THEN 'pending' ELSE 'approved' END AS validation_status,
                 list_distinct(list_concat(conditions, ['extra=' || CAST(plan_id % 3 AS VARCHAR)])) AS signatures FROM ext),
m AS (SELECT q.plan_id, q.step_order, min(r.rule_id) AS rule_id FROM req q JOIN rules r
        ON r.customer = q.customer AND r.active AND r.validation_status = 'approved' AND list_has_all(r.signatures, q.expected)
      GROUP BY q.plan_id, q.step_order)
SELECT q.plan_id, q.step_order, m.rule_id FROM req q LEFT JOIN m ON m.plan_id = q.plan_id AND m.step_order = q.step_order""",
)
def rule_subset_match(spark, sf):
    requests, rules = _rules_and_requests(spark, sf)
    return J.rule_subset_match(requests, rules, ["plan_id", "step_order"])


# ------------------------------------------------------------------ J11 / W5
TERM_DICTIONARY = [
    # user_term, target_table, source_channel, priority, active (configuration rows)
    ("the", "DA", "A", 1, True), ("and the", "DA", "R", 2, True), ("und", "SA", "1-URGENT", 1, True),
    ("der die", "SA", "2-HIGH", 2, True), ("le", "SA", "5-LOW", 3, True), ("et la", "SA", "3-MEDIUM", 1, True),
    ("ou", "DA", "N", 5, True), ("of", "DA", "Q", 1, True), ("ein", "SA", "4-NOT SPECIFIED", 1, False),
]
_DICT_SCHEMA = "user_term string, target_table string, source_channel string, priority int, active boolean"


def _dict_hits(spark, sf):
    a = stg_a(spark, sf).select(F.lit("DA").alias("target_table"), "source_channel").distinct()
    b = stg_b(spark, sf).select(F.lit("SA").alias("target_table"), "source_channel").distinct()
    live = a.unionByName(b)
    d = spark.createDataFrame(TERM_DICTIONARY, _DICT_SCHEMA)
    texts = load(spark, sf, "conversations")
    return J.term_dictionary_join(texts, d, live, ["conv_id", "turn"])


def _term_hit_sql(term: str) -> str:
    toks = [t for t in term.lower().split() if t]
    tok = " AND ".join(f"contains(nos, '{t}')" for t in toks)
    return f"(contains(low, '{term.lower()}') OR ({tok}))"


_HITS_SQL = with_staging("stg_a", "stg_b") + """, live AS (SELECT DISTINCT 'DA' AS target_table, source_channel FROM stg_a
                UNION SELECT DISTINCT 'SA', source_channel FROM stg_b),
t AS (SELECT conv_id, turn, lower(text) AS low, regexp_replace(lower(text), '\\s+', '', 'g') AS nos FROM conversations),
hits AS (""" + "\n  UNION ALL ".join(
    f"SELECT conv_id, turn, '{tt}' AS target_table, '{ch}' AS source_channel, '{u}' AS user_term, {p} AS priority FROM t "
    f"WHERE {_term_hit_sql(u)} AND EXISTS (SELECT 1 FROM live WHERE target_table = '{tt}' AND source_channel = '{ch}')"
    for u, tt, ch, p, a in TERM_DICTIONARY if a
) + ")\n"


@register(
    "term_dictionary_join",
    _HITS_SQL + """SELECT conv_id, turn, min(target_table) AS target_table,
  array_to_string(list_sort(list_distinct(list(source_channel))), ',') AS channels
FROM hits GROUP BY conv_id, turn HAVING count(DISTINCT target_table) = 1""",
)
def term_dictionary_join(spark, sf):
    return J.unambiguous_channels(_dict_hits(spark, sf), ["conv_id", "turn"])


@register(
    "priority_pick",
    _HITS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY priority, user_term, source_channel) AS rn FROM hits)
SELECT conv_id, turn, target_table, source_channel, user_term FROM r WHERE rn = 1""",
)
def priority_pick(spark, sf):
    return J.priority_pick(_dict_hits(spark, sf), ["conv_id", "turn"])


# ------------------------------------------------------------------ W2 / W3 / W6 / W9
_W2_COLS = ["source_channel", "campaign", "day", "ad_group", "device", "cost", "sessions"]


@register(
    "top_values",
    with_staging("stg_b")
    + ", u AS (" + "\n UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM stg_b" for c in _W2_COLS) + """),
f AS (SELECT column_name, value, count(*) AS frequency FROM u WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY frequency DESC, value ASC) AS value_rank FROM f)
SELECT * FROM r WHERE value_rank <= 50""",
)
def top_values(spark, sf):
    return C.top_values(C.value_frequencies(stg_b(spark, sf), _W2_COLS), FV.VALUES_PER_COLUMN)


@register(
    "sample_rows",
    with_staging("stg_e")
    + """SELECT row_id, value, (SELECT count(*) FROM stg_e WHERE source_channel = 'purchase') AS affected_count,
  (SELECT count(*) FROM stg_e WHERE source_channel = 'purchase') > 2 AS limited
FROM stg_e WHERE source_channel = 'purchase' ORDER BY row_id LIMIT 2""",
)
def sample_rows(spark, sf):
    e = stg_e(spark, sf)
    return OV.preview_bundle(e, F.col("source_channel") == "purchase", ["row_id", "value"], n=FV.PREVIEW_SAMPLE_ROWS)


@register("order_detail", with_staging("stg_e") + "SELECT row_id, source_channel, day, value FROM stg_e ORDER BY row_id")
def order_detail(spark, sf):
    return stg_e(spark, sf).select("row_id", "source_channel", "day", "value").orderBy("row_id")


@register(
    "dedupe_preserve_order",
    """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS toks FROM conversations),
u AS (SELECT conv_id, turn, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM t),
f AS (SELECT conv_id, turn, tok, min(pos) AS pos FROM u GROUP BY conv_id, turn, tok)
SELECT conv_id, turn, string_agg(tok, ',' ORDER BY pos) AS distinct_tokens, CAST(count(*) AS INTEGER) AS n_distinct
FROM f GROUP BY conv_id, turn""",
)
def dedupe_preserve_order(spark, sf):
    c = load(spark, sf, "conversations")
    d = F.array_distinct(F.split("text", " "))
    return c.select("conv_id", "turn", F.array_join(d, ",").alias("distinct_tokens"), F.size(d).alias("n_distinct"))
