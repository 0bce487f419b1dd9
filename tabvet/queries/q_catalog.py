"""Queries for catalogs and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.operators import catalog as C
from tabvet.operators import similarity as SIM
from tabvet.queries.q_projections import _role_sql
from tabvet.queries.registry import register
from tabvet.sources.tables import header_cells, load, stg_k, with_staging

K_COLS = ["row_id", "source_channel", "캠페인", "날짜", "광고 그룹", "디바이스", "비용", "세션수", "캠페인 유형"]
_NT = "lower(regexp_replace(nfc_normalize({x}), '\\s+', '', 'g'))"


def nt(x: str) -> str:
    return _NT.format(x=x)


@register(
    "column_catalog",
    with_staging("stg_k")
    + ", d AS (" + "\n UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT CAST(\"{c}\" AS VARCHAR)) AS distinct_count FROM stg_k" for c in K_COLS
    ) + f""")
SELECT 'SA' AS target_table, column_name, {nt('column_name')} AS normalized_name, {_role_sql(nt('column_name'))} AS semantic_role,
  distinct_count FROM d""",
)
def column_catalog(spark, sf):
    return C.column_catalog(stg_k(spark, sf), "SA")


_VALUE_COLS = [c for c in K_COLS if c not in FV.SKIP_VALUE_COLUMNS]
_VALUE_CATALOG_SQL = with_staging("stg_k") + ", u AS (" + "\n UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(\"{c}\" AS VARCHAR) AS value FROM stg_k" for c in _VALUE_COLS
) + f"""),
f AS (SELECT column_name, value, count(*) AS frequency FROM u WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY frequency DESC, value ASC) AS value_rank FROM f),
t AS (SELECT *, {nt('value')} AS normalized_value FROM r WHERE value_rank <= 50),
w AS (SELECT *, row_number() OVER (PARTITION BY column_name, normalized_value ORDER BY value_rank DESC) AS k FROM t),
vc AS (SELECT 'SA' AS target_table, column_name, normalized_value, value AS raw_value, frequency FROM w WHERE k = 1)
"""


@register("value_catalog", _VALUE_CATALOG_SQL + "SELECT * FROM vc")
def value_catalog(spark, sf):
    return C.value_catalog(stg_k(spark, sf), "SA")


@register(
    "catalog_union",
    _VALUE_CATALOG_SQL + """SELECT DISTINCT * FROM (
  SELECT 'column' AS kind, 'SA' AS target_table, column_name, column_name AS candidate FROM (VALUES """
    + ", ".join(f"('{c}')" for c in K_COLS) + """) v(column_name)
  UNION ALL SELECT 'value', target_table, column_name, raw_value FROM vc
  UNION ALL SELECT DISTINCT 'value', 'SA', 'source_channel', source_channel FROM stg_k WHERE source_channel IS NOT NULL)""",
)
def catalog_union(spark, sf):
    return _candidates(spark, sf).drop("floor_rule")


def _candidates(spark, sf):
    k = stg_k(spark, sf)
    cols = C.column_catalog(k, "SA").select(F.lit("column").alias("kind"), "target_table", "column_name",
                                            F.col("column_name").alias("candidate"), F.lit("contain").alias("floor_rule"))
    vals = C.value_catalog(k, "SA").select(F.lit("value").alias("kind"), "target_table", "column_name",
                                           F.col("raw_value").alias("candidate"), F.lit(None).cast("string").alias("floor_rule"))
    chans = k.where(F.col("source_channel").isNotNull()).select(
        F.lit("value").alias("kind"), F.lit("SA").alias("target_table"), F.lit("source_channel").alias("column_name"),
        F.col("source_channel").alias("candidate"), F.lit(None).cast("string").alias("floor_rule")).distinct()
    return C.catalog_candidates(cols, vals.unionByName(chans))


#: Terms that mean a channel (configuration rows): user term, table, channel.
CHANNEL_TERMS = [("urgent", "SA", "1-URGENT"), ("high", "SA", "2-HIGH"), ("medium", "SA", "3-MEDIUM"), ("low orders", "SA", "5-LOW"),
                 ("unspecified", "SA", "4-NOT SPECIFIED")]
_ALIAS_ROWS = [(a, c) for c, names in FV.HEADER_ALIASES.items() for a in names if c in K_COLS]


def _search_rows(spark, sf):
    """What terms are compared with: the candidates under their own names, and alias and channel-map rows under theirs."""
    own = _candidates(spark, sf).withColumn("match_text", F.col("candidate"))
    aliases = spark.createDataFrame(_ALIAS_ROWS, "match_text string, candidate string").select(
        F.lit("column").alias("kind"), F.lit("SA").alias("target_table"), F.col("candidate").alias("column_name"), "candidate",
        F.lit("alias").alias("floor_rule"), "match_text")
    channels = spark.createDataFrame(CHANNEL_TERMS, "match_text string, target_table string, candidate string").select(
        F.lit("value").alias("kind"), "target_table", F.lit("source_channel").alias("column_name"), "candidate",
        F.lit("alias").alias("floor_rule"), "match_text")
    return own.unionByName(aliases).unionByName(channels)


def _terms(spark, sf):
    c = load(spark, sf, "conversations", fan_out=True)
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}#-]+"))
    return c.select(words.alias("term")).where(F.col("term") != "").distinct()


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


# Every pair of keys, by the common characters or by containment.
_PAIRS_SQL = _VALUE_CATALOG_SQL + f""", texts AS (
  SELECT column_name AS x, TRUE AS live FROM (VALUES {_values((c,) for c in K_COLS)}) v(column_name)
  UNION ALL SELECT raw_value, FALSE FROM vc
  UNION ALL SELECT source_channel, FALSE FROM stg_k
  UNION ALL SELECT a, FALSE FROM (VALUES {_values(_ALIAS_ROWS)}) v(a, c)
  UNION ALL SELECT u, FALSE FROM (VALUES {_values(CHANNEL_TERMS)}) v(u, t, c)),
keys_c AS (SELECT {nt('x')} AS ck, bool_or(live) AS live FROM texts WHERE {nt('x')} <> '' GROUP BY 1),
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}#-]+')) AS term FROM conversations),
keys_t AS (SELECT DISTINCT {nt('term')} AS tk, list_distinct(string_split({nt('term')}, '')) AS chars FROM words WHERE {nt('term')} <> ''),
met AS (SELECT tk, ck, live AND (contains(tk, ck) OR contains(ck, tk)) AS contained, length(tk) + length(ck) AS total,
        list_sum(list_transform(chars, lambda ch: least(length(tk) - length(replace(tk, ch, '')), length(ck) - length(replace(ck, ch, ''))))) AS common
      FROM keys_t, keys_c)
SELECT tk, ck, contained FROM met WHERE contained OR 2 * common >= 0.45 * total
"""


@register("similarity_pairs", _PAIRS_SQL)
def similarity_pairs(spark, sf):
    """The pairs that the candidate indexes hand to the exact ratio."""
    return SIM.candidate_pairs(*SIM.keyed(_terms(spark, sf), _search_rows(spark, sf)))


def _longest(a: str, b: str) -> str:
    """The longest text that stands in both, the first of them in ``a``: {length, minus its place}."""
    sizes = f"list_filter(range(1, length({a}) - i + 2), lambda k: contains({b}, substring({a}, i, k)))"
    return f"list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform({sizes}, lambda k: {{'k': k, 'i': -i}}))))"


def _scores_sql(pairs_sql: str) -> str:
    """``scored``: Ratcliff-Obershelp ratios of the pairs (tk, ck, contained), with floors, over ``words`` and ``search``.

    The longest common text of a pair counts, then those left and right of it, until nothing is common."""
    return f""", pairs AS ({pairs_sql}),
seg AS (
  SELECT tk, ck, tk AS a, ck AS b, {_longest('tk', 'ck')} AS m FROM pairs
  UNION ALL
  SELECT tk, ck, x.a, x.b, {_longest('x.a', 'x.b')} FROM (
    SELECT tk, ck, unnest([
      {{'a': substring(a, 1, -m.i - 1), 'b': substring(b, 1, instr(b, substring(a, -m.i, m.k)) - 1)}},
      {{'a': substring(a, -m.i + m.k), 'b': substring(b, instr(b, substring(a, -m.i, m.k)) + m.k)}}]) AS x FROM seg WHERE m IS NOT NULL)
  WHERE x.a <> '' AND x.b <> ''),
ratios AS (SELECT tk, ck, 2.0::DOUBLE * COALESCE(sum(m.k), 0) / (length(tk) + length(ck)) AS ratio FROM seg GROUP BY tk, ck),
floored AS (SELECT w.term, s.*, CASE WHEN s.floor_rule = 'contain' AND p.contained THEN greatest(r.ratio, {FV.CONTAINMENT_FLOOR}::DOUBLE) ELSE r.ratio END AS score
  FROM pairs p JOIN ratios r USING (tk, ck) JOIN words w ON {nt('w.term')} = p.tk JOIN search s ON {nt('s.match_text')} = p.ck),
scored AS (SELECT term, kind, target_table, column_name, candidate,
    max(round(CASE WHEN floor_rule = 'alias' THEN greatest(score, {FV.ALIAS_FLOOR}::DOUBLE) ELSE score END, 3)) AS score
  FROM floored WHERE score >= {FV.SIMILARITY_CUT}::DOUBLE GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term, kind ORDER BY score DESC, candidate, target_table, column_name) AS rank FROM scored)
"""


_CONFIDENCE_SQL = f"""CASE WHEN score >= {FV.CONFIDENCE_HIGH}::DOUBLE THEN 'high' WHEN score >= {FV.CONFIDENCE_MEDIUM}::DOUBLE THEN 'medium' ELSE 'low' END"""

_SEARCH_SQL = f""", search AS (
  SELECT 'column' AS kind, 'SA' AS target_table, c AS column_name, c AS candidate, 'contain' AS floor_rule, c AS match_text
    FROM (VALUES {_values((c,) for c in K_COLS)}) v(c)
  UNION ALL SELECT DISTINCT 'value', 'SA', column_name, raw_value, NULL, raw_value FROM
    (SELECT column_name, raw_value FROM vc UNION ALL SELECT 'source_channel', source_channel FROM stg_k WHERE source_channel IS NOT NULL)
  UNION ALL SELECT 'column', 'SA', c, c, 'alias', a FROM (VALUES {_values(_ALIAS_ROWS)}) v(a, c)
  UNION ALL SELECT 'value', t, 'source_channel', c, 'alias', u FROM (VALUES {_values(CHANNEL_TERMS)}) v(u, t, c))
"""
_FOUND_SQL = "SELECT tk, ck, contained FROM met WHERE contained OR 2 * common >= 0.45 * total"
_C4_SQL = (_PAIRS_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace(_FOUND_SQL, "") + _SEARCH_SQL + _scores_sql(_FOUND_SQL))


@register("similarity_candidates", _C4_SQL + f"SELECT * FROM ranked WHERE rank <= {FV.TOP_RECOMMENDATIONS}")
def similarity_candidates_q(spark, sf):
    return SIM.similarity_candidates(_terms(spark, sf), _search_rows(spark, sf))


@register(
    "fuzzy_term_join",
    _C4_SQL + f"""SELECT term, kind, target_table, column_name, candidate AS recommended_term, score, {_CONFIDENCE_SQL} AS confidence
FROM ranked WHERE rank <= {FV.TOP_RECOMMENDATIONS}""",
)
def fuzzy_term_join(spark, sf):
    """Each request term joined to its recommended candidates with confidence."""
    return SIM.recommendations(SIM.similarity_candidates(_terms(spark, sf), _search_rows(spark, sf))).drop("action", "rank")


# ------------------------------------------------------------------ W8 / C5 over the part catalog
#: Terms as requests write them (configuration rows).
PART_TERMS = ["red widgit", "Blue bolts", "small ring", "bolt", "steel frame", "Brand 12", "econmy", "p name"]
_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_PART_VALUES = ["p_name", "p_brand", "p_type"]


def part_scores(spark, sf):
    """Terms of requests against the columns of ``part`` and the distinct values of its text columns."""
    values = C.value_frequencies(load(spark, sf, "part"), _PART_VALUES).select(
        F.lit("value").alias("kind"), F.lit("part").alias("target_table"), "column_name", F.col("value").alias("candidate"),
        F.lit(None).cast("string").alias("floor_rule"))
    columns = spark.createDataFrame([("column", "part", c, c, "contain") for c in _PART_COLS], values.schema)
    return SIM.scored_candidates(spark.createDataFrame([(t,) for t in PART_TERMS], "term string"), values.unionByName(columns))


PART_SCORES_SQL = f"""WITH RECURSIVE words AS (SELECT * FROM (VALUES {_values((t,) for t in PART_TERMS)}) v(term)),
search AS (
  SELECT 'column' AS kind, 'part' AS target_table, c AS column_name, c AS candidate, 'contain' AS floor_rule, c AS match_text
    FROM (VALUES {_values((c,) for c in _PART_COLS)}) v(c)
  """ + "\n  ".join(f"UNION ALL SELECT DISTINCT 'value', 'part', '{c}', {c}, NULL, {c} FROM part WHERE trim({c}) <> ''" for c in _PART_VALUES) + f"""),
met AS (SELECT tk, ck, bool_or(floor_rule = 'contain' AND (contains(tk, ck) OR contains(ck, tk))) AS contained FROM
  (SELECT {nt('term')} AS tk FROM words), (SELECT {nt('match_text')} AS ck, COALESCE(floor_rule, '') AS floor_rule FROM search)
  WHERE tk <> '' AND ck <> '' GROUP BY tk, ck)
""" + _scores_sql("SELECT tk, ck, contained FROM met")


@register("top_recommendations", PART_SCORES_SQL + f"SELECT * FROM ranked WHERE rank <= {FV.TOP_RECOMMENDATIONS}")
def top_recommendations(spark, sf):
    return SIM.top_recommendations(part_scores(spark, sf))


@register(
    "recommendations",
    PART_SCORES_SQL + f"""SELECT term, kind, target_table, column_name, candidate AS recommended_term, score, {_CONFIDENCE_SQL} AS confidence,
  'rerun_preview' AS action FROM scored""",
)
def recommendations(spark, sf):
    """Every candidate of a term as a recommendation."""
    return SIM.recommendations(part_scores(spark, sf))


_ALL_ALIASES = sorted({a for names in FV.HEADER_ALIASES.values() for a in names} | set(FV.HEADER_ALIASES))


@register(
    "unresolved_terms",
    with_staging("header_cells")
    + f""", known AS (SELECT {nt('x')} AS k FROM (VALUES {", ".join(f"('{c}')" for c in K_COLS + _ALL_ALIASES)}) v(x))
SELECT DISTINCT raw_header AS term FROM header_cells WHERE {nt('raw_header')} NOT IN (SELECT k FROM known)""",
)
def unresolved_terms(spark, sf):
    terms = header_cells(spark, sf).select(F.col("raw_header").alias("term")).distinct()
    cols = spark.createDataFrame([(c,) for c in K_COLS], "column_name string")
    aliases = spark.createDataFrame([(a,) for a in _ALL_ALIASES], "user_term string")
    return C.unresolved_terms(terms, cols, aliases)

