"""Queries for request-text jobs (T1-T9) over request texts built from
conversations (a request phrase in front of the whole conversation turn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators import textjobs as T
from tabvet.operators import similarity as SIM
from tabvet.queries.q_catalog import PART_SCORES_SQL, PART_TERMS, part_scores
from tabvet.queries.registry import register
from tabvet.sources.tables import load

# request phrases (configuration) placed in front of each conversation turn
REQUEST_TEMPLATES = (
    "검색광고 2024년 5월 클릭률 계산해줘",
    "디스플레이 광고 비용 0으로 보정해줘, 그리고 노출 합계 보여줘",
    "캠페인별 노출 합계와 평균 클릭 알려줘",
    "클릭 없는 데이터 조회",
    "세션 있는 행만 확인",
    "비용 비어 있는 row 샘플",
    "새 컬럼 만들어 `고가` 분류값을 붙여줘",
    "프로모션 상태값을 확인중으로 기입",
    "3월 날짜별 데이터 보여줘",
    "노출수 1,234로 수정",
    "검색광고 클릭 합계 디스플레이광고 노출 합계 비교 배너 광고 클릭",
    "오늘 날씨",
    "13월 비용 12,500원으로 변경하고 디바이스별 세션 평균",
    "캠페인 기준 노출 합계, 기기별 클릭 평균",
)
DEFAULT_YEAR = 2024
SEGMENT_TOKENS = ("클릭", "노출")


def _requests(spark, sf):
    c = load(spark, sf, "conversations", fan_out=True)  # regex-heavy text jobs
    idx = ((F.col("conv_id") * 7 + F.col("turn")) % len(REQUEST_TEMPLATES) + 1).cast("int")
    tpl = F.element_at(F.array(*[F.lit(t) for t in REQUEST_TEMPLATES]), idx)
    return c.select("conv_id", "turn", F.concat(tpl, F.lit(" "), F.col("text")).alias("request"))


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REQ_SQL = f"""WITH req AS (
  SELECT conv_id, turn, [{", ".join(_sq(t) for t in REQUEST_TEMPLATES)}][((conv_id * 7 + turn) % {len(REQUEST_TEMPLATES)}) + 1]
         || ' ' || text AS request FROM conversations),
cr AS (SELECT *, lower(regexp_replace(request, '\\s+', '', 'g')) AS c, lower(request) AS low FROM req)
"""


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sq(w)})" for w in words) + ")"


@register(
    "classify_intent",
    REQ_SQL + f"""SELECT conv_id, turn, CASE WHEN {_any_sql('low', T.DERIVED_KEYWORDS)} THEN 'ADD_DERIVED_COLUMN'
  WHEN {_any_sql('c', T.UPDATE_TERMS)} THEN 'UPDATE_NUMERIC_VALUE'
  WHEN {_any_sql('low', T.AGGREGATE_KEYWORDS)} THEN 'SELECT_AGGREGATE'
  WHEN {_any_sql('low', T.DETAIL_KEYWORDS)} THEN 'SELECT_DETAIL' ELSE 'ASK_CLARIFICATION' END AS intent_type FROM cr""",
)
def classify_intent(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", T.classify_intent(F.col("request")).alias("intent_type"))


@register(
    "extract_month_period",
    REQ_SQL + f""", m AS (SELECT conv_id, turn, regexp_extract(request, {_sq(T.MONTH_PATTERN)}, 1) AS y,
                 regexp_extract(request, {_sq(T.MONTH_PATTERN)}, 2) AS mo FROM req),
d AS (SELECT conv_id, turn, CASE WHEN y = '' THEN {DEFAULT_YEAR} ELSE CAST(y AS INTEGER) END AS yy,
        CASE WHEN mo = '' THEN NULL ELSE CAST(mo AS INTEGER) END AS mm FROM m),
s AS (SELECT conv_id, turn, CASE WHEN mm BETWEEN 1 AND 12 THEN make_date(yy, mm, 1) END AS st FROM d)
SELECT conv_id, turn, strftime(st, '%Y-%m-%d') AS start_date, strftime(last_day(st), '%Y-%m-%d') AS end_date FROM s""",
)
def extract_month_period(spark, sf):
    r = _requests(spark, sf)
    p = T.month_period(F.col("request"), DEFAULT_YEAR)
    return r.select("conv_id", "turn", p["start"].alias("start_date"), p["end"].alias("end_date"))


@register(
    "extract_update_value",
    REQ_SQL + "SELECT conv_id, turn, replace(COALESCE("
    + ", ".join(f"NULLIF(regexp_extract(request, {_sq(p)}, 1), '')" for p in T.UPDATE_VALUE_PATTERNS)
    + "), ',', '') AS update_value FROM req",
)
def extract_update_value(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", T.update_value(F.col("request")).alias("update_value"))


def _field_value_sql(field: str) -> str:
    tries = []
    for alias in dict.fromkeys([field, *T.NUMERIC_FIELD_ALIASES[field]]):
        p = _sq(T.field_mention_regex(alias))
        tries += [f"NULLIF(regexp_extract(marked, {p}, {g}), '')" for g in (1, 2)]
        short = alias.replace(" ", "").lower()
        tries.append(f"CASE WHEN contains(c, {_sq(short)}) AND contains(c, {_sq(T.CORRECTION_WORD)}) THEN '0' END")
    return f"SELECT conv_id, turn, {_sq(field)} AS field, replace(COALESCE({', '.join(tries)}), ',', '') AS update_value FROM named"


@register(
    "field_update_values",
    REQ_SQL + f""", named AS (SELECT conv_id, turn, c,
  regexp_replace(replace(request, chr(1), ' '), {_sq(T.field_name_regex(T.NUMERIC_FIELD_ALIASES))}, chr(1) || '\\1', 'g') AS marked FROM cr)
SELECT * FROM ({" UNION ALL ".join(_field_value_sql(f) for f in T.NUMERIC_FIELD_ALIASES)}) WHERE update_value IS NOT NULL""",
)
def field_update_values(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", F.inline(T.field_update_values(F.col("request")))).withColumnRenamed("value", "update_value")


_SPLIT_EMUL = T.CLAUSE_SPLIT.replace(r"|(?<=[.!?])\s+", "")


@register(
    "split_clauses",
    REQ_SQL + f""", s AS (SELECT conv_id, turn,
    regexp_split_to_array(regexp_replace(request, '([.!?])\\s+', '\\1' || chr(1), 'g'), {_sq(_SPLIT_EMUL)} || '|' || chr(1)) AS parts FROM req),
u AS (SELECT conv_id, turn, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos FROM s),
t AS (SELECT conv_id, turn, pos, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS clause FROM u)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS clause_no, clause FROM t WHERE clause <> ''""",
)
def split_clauses(spark, sf):
    return T.split_clauses(_requests(spark, sf), "request", ["conv_id", "turn"])


def _presence_sql() -> str:
    parts = []
    for field, aliases in T.NUMERIC_FIELD_ALIASES.items():
        whens = " ".join(f"WHEN regexp_matches(c, {_sq(T.field_term_regex(aliases, terms))}) THEN '{name}'"
                         for name, terms in T.CONDITION_GROUPS)
        parts.append(f"SELECT conv_id, turn, '{field}' AS field, CASE {whens} END AS operator FROM cr")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE operator IS NOT NULL"


@register("presence_zero_empty", REQ_SQL + _presence_sql())
def presence_zero_empty(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", F.explode(T.presence_conditions(F.col("request"))).alias("p")).select(
        "conv_id", "turn", "p.field", "p.operator")


_MARKERS = [(t, tb) for tb, terms in T.MEDIA_TABLE_TERMS.items() for t in terms]
_MARKER_RE = "(" + "|".join(t for t, _ in _MARKERS) + ")"


@register(
    "media_segments",
    REQ_SQL + f""", s AS (SELECT conv_id, turn, string_split(regexp_replace(request, {_sq(_MARKER_RE)}, chr(1) || '\\1', 'g'), chr(1)) AS parts FROM req),
u AS (SELECT conv_id, turn, unnest(parts) AS seg, generate_subscripts(parts, 1) AS pos FROM s),
g AS (SELECT DISTINCT conv_id, turn, seg, CASE {" ".join(f"WHEN starts_with(seg, {_sq(t)}) THEN '{tb}'" for t, tb in _MARKERS)} END AS tbl
      FROM u WHERE pos > 1),
sc AS (SELECT conv_id, turn, tbl AS "table", sum({" + ".join(f"CASE WHEN contains(lower(regexp_replace(seg, '\\s+', '', 'g')), {_sq(t)}) THEN 1 ELSE 0 END" for t in SEGMENT_TOKENS)}) AS score
       FROM g GROUP BY conv_id, turn, tbl),
b AS (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS best FROM sc)
SELECT conv_id, turn, "table", CAST(score AS BIGINT) AS score FROM b WHERE score = best AND score > 0""",
)
def media_segments(spark, sf):
    out = T.media_segments(_requests(spark, sf), "request", ["conv_id", "turn"], SEGMENT_TOKENS)
    return out.select("conv_id", "turn", "table", F.col("score").cast("long").alias("score"))


def _mentions_sql() -> str:
    parts = []
    for field, aliases in T.NUMERIC_FIELD_ALIASES.items():
        named = _any_sql("c", [a.replace(" ", "").lower() for a in aliases])
        for word, kind in T.AGG_WORDS.items():
            parts.append(f"SELECT conv_id, turn, 'metric' AS kind, '{field}' AS field, '{kind}' AS expression_type, "
                         f"'{field} {word}' AS alias FROM cr WHERE {named} AND contains(c, '{word}')")
    for field, markers in T.GROUP_BY_MARKERS:
        parts.append(f"SELECT conv_id, turn, 'group_by', '{field}', CAST(NULL AS VARCHAR), '{field}' FROM cr WHERE {_any_sql('c', markers)}")
    return " UNION ALL ".join(parts)


@register("metric_mentions", REQ_SQL + _mentions_sql())
def metric_mentions(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", F.explode(T.metric_mentions(F.col("request"))).alias("m")).select(
        "conv_id", "turn", "m.kind", "m.field", "m.expression_type", "m.alias")


def _norm(x: str) -> str:
    return f"NULLIF(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


@register(
    "derived_label_extract",
    REQ_SQL + f""", q AS (SELECT conv_id, turn, request, regexp_extract_all(request, {_sq(T.QUOTED_PATTERN)}, 1) AS qs FROM req),
x AS (SELECT conv_id, turn, request,
  CASE WHEN len(qs) > 0 THEN trim(qs[-1]) END AS q_last, CASE WHEN len(qs) >= 2 THEN trim(qs[1]) END AS q_first,
  {_norm(f"regexp_extract(request, {_sq(T.ASSIGNMENT_PATTERN)}, 1)")} AS a_key,
  {_norm(f"regexp_extract(request, {_sq(T.ASSIGNMENT_PATTERN)}, 2)")} AS a_val,
  {_norm(f"regexp_extract(request, {_sq(T.LABEL_PATTERN)}, 1)")} AS l_val,
  {_norm(f"regexp_extract(request, {_sq(T.LABEL_PATTERN)}, 2)")} AS l_key_raw FROM q)
SELECT conv_id, turn,
  COALESCE(a_key, CASE WHEN l_key_raw = '값' THEN 'derived_label' ELSE l_key_raw END, q_first,
           CASE WHEN contains(request, '광고상품') THEN '광고상품명' WHEN contains(request, '구분 항목') THEN '구분 항목' END,
           'derived_label') AS derived_key,
  COALESCE(q_last, a_val, l_val) AS derived_value
FROM x""",
)
def derived_label_extract(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", T.derived_label(F.col("request")).alias("label")).select("conv_id", "turn", "label.derived_key", "label.derived_value")


@register(
    "recommend_rewrite",
    PART_SCORES_SQL + f""", best AS (SELECT term, candidate AS rec, row_number() OVER (PARTITION BY term ORDER BY score DESC, candidate) AS k FROM scored),
top AS (SELECT DISTINCT term, rec FROM best WHERE k = 1),
q AS (SELECT conv_id, turn, [{", ".join(_sq(t) for t in PART_TERMS)}][(conv_id % {len(PART_TERMS)}) + 1] AS term, text FROM conversations),
q2 AS (SELECT conv_id, turn, term, CASE WHEN turn % 2 = 0 THEN term || ' ' || text ELSE text END AS request FROM q)
SELECT conv_id, turn, CASE WHEN trim(q2.term) <> '' AND trim(top.rec) <> '' AND contains(request, trim(q2.term)) THEN replace(request, trim(q2.term), trim(top.rec))
  WHEN trim(top.rec) <> '' THEN concat_ws(chr(10), NULLIF(request, ''), {_sq(T.REWRITE_PREFIX)} || trim(top.rec))
  ELSE request END AS rewritten
FROM q2 LEFT JOIN top ON top.term = q2.term""",
)
def recommend_rewrite(spark, sf):
    top = SIM.best_recommendation(part_scores(spark, sf))
    c = load(spark, sf, "conversations")
    term = F.element_at(F.array(*[F.lit(t) for t in PART_TERMS]), (F.col("conv_id") % len(PART_TERMS) + 1).cast("int"))
    q = c.select("conv_id", "turn", term.alias("term"), "text")
    q = q.select("conv_id", "turn", "term",
                 F.when(F.col("turn") % 2 == 0, F.concat("term", F.lit(" "), "text")).otherwise(F.col("text")).alias("request"))
    # at most one recommendation per configured term: a bounded broadcast side
    j = q.join(F.broadcast(top), "term", "left")
    return j.select("conv_id", "turn", T.recommend_rewrite(F.col("request"), F.col("term"), F.col("recommended")).alias("rewritten"))
