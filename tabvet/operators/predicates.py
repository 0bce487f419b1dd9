"""Condition trees -> one Spark ``Column``.

A condition is a small dict from the request spec:
``{"field", "operator", "values", "conditions"}``.  The compiled predicate is
a Column expression (never SQL text), so Catalyst can push the parts that
touch raw columns into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions.semantics import dec_lit, is_numeric_literal, num

class ConditionError(ValueError):
    pass


def _and(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _or(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def comparison_column(column: str, values: Sequence[object], numeric_columns: Sequence[str]) -> tuple[Column, bool]:
    """D3: numeric compare when the column is a metric or any value looks numeric."""
    if column in numeric_columns or any(is_numeric_literal(v) for v in values):
        return num(column), True
    return F.col(column), False


def alias_candidates(field: str, columns: Sequence[str], alias_map: Mapping[str, Sequence[str]] | None) -> list[str]:
    if field in columns or not alias_map:
        return []
    return [c for c in alias_map.get(field, []) if c in columns]


def _compared(test: Callable[..., Column]) -> Callable[[str, list, Sequence[str]], Column]:
    """A test on the column as a number where it or a value is numeric, else on its text."""
    def build(column: str, values: list, numeric_columns: Sequence[str]) -> Column:
        left, numeric = comparison_column(column, values, numeric_columns)
        return test(left, *[dec_lit(v) if numeric else F.lit(str(v)) for v in values])

    return build


def _text(test: Callable[[Column, list[str]], Column]) -> Callable[[str, list, Sequence[str]], Column]:
    """A test on the column's text."""
    return lambda column, values, _: test(F.col(column), [str(v) for v in values])


_BLANK = lambda c: F.trim(c) == ""
_MANY = range(1, 1 << 31)

#: Operator -> its forms, each the numbers of values it takes and its test.
OPERATORS: dict[str, list[tuple[range, Callable[[str, list, Sequence[str]], Column]]]] = {
    "eq": [(range(1, 2), _compared(lambda c, v: c == v)), (_MANY, _text(lambda c, v: c.isin(v)))],
    "in": [(_MANY, _text(lambda c, v: c.isin(v)))],
    "neq": [(range(1, 2), _text(lambda c, v: c != v[0]))],
    "contains": [(range(1, 2), _text(lambda c, v: c.like(f"%{v[0]}%")))],
    "not_contains": [(range(1, 2), _text(lambda c, v: ~c.like(f"%{v[0]}%")))],
    "gt": [(range(1, 2), _compared(lambda c, v: c > v))],
    "gte": [(range(1, 2), _compared(lambda c, v: c >= v))],
    "lt": [(range(1, 2), _compared(lambda c, v: c < v))],
    "lte": [(range(1, 2), _compared(lambda c, v: c <= v))],
    "between": [(range(2, 3), _compared(lambda c, lo, hi: c.between(lo, hi)))],
    "is_null": [(range(1 << 31), _text(lambda c, v: c.isNull()))],
    "is_empty": [(range(1 << 31), _text(lambda c, v: _BLANK(F.coalesce(c, F.lit("")))))],
    "is_null_or_empty": [(range(1 << 31), _text(lambda c, v: c.isNull() | _BLANK(c)))],
    "is_not_null_or_empty": [(range(1 << 31), _text(lambda c, v: c.isNotNull() & ~_BLANK(c)))],
}
#: Other names of operators.
OPERATOR_NAMES = {"like": "contains", "not_null_or_empty": "is_not_null_or_empty"}
#: How the children of a group are combined (F8).
GROUPS = {"and": _and, "or": _or}


def compile_condition(
    cond: Mapping,
    columns: Sequence[str],
    numeric_columns: Sequence[str] = FV.NUMERIC_COLUMNS,
    alias_map: Mapping[str, Sequence[str]] | None = None,
) -> Column:
    """One condition or group of conditions as a predicate.

    A group without children but with a field of its own is a condition on that
    field; a field that an alias maps to several columns holds if any of them does (F13)."""
    op = str(cond.get("operator", "eq")).lower()
    op = OPERATOR_NAMES.get(op, op)
    field, values = str(cond.get("field") or ""), list(cond.get("values") or [])
    if op in GROUPS:
        kids = [compile_condition(c, columns, numeric_columns, alias_map) for c in cond.get("conditions", []) if isinstance(c, Mapping)]
        if kids:
            return GROUPS[op](kids)
        if field in ("", "__group__"):
            raise ConditionError(f"group_without_children: {op}")
        op = "eq"
    mapped = alias_candidates(field, columns, alias_map) or [field]
    forms = [test for counts, test in OPERATORS.get(op, []) if len(values) in counts]
    if not set(mapped) <= set(columns) or not forms:
        raise ConditionError(f"condition_not_applicable: {field} {op} {values}")
    return _or([forms[0](column, values, numeric_columns) for column in mapped])


def compile_where(
    groups: Sequence[Mapping],
    columns: Sequence[str],
    numeric_columns: Sequence[str] = FV.NUMERIC_COLUMNS,
    alias_map: Mapping[str, Sequence[str]] | None = None,
) -> Column:
    """All conditions of all groups ANDed; no conditions -> TRUE."""
    parts = [
        compile_condition(c, columns, numeric_columns, alias_map)
        for g in groups
        for c in g.get("conditions", [])
    ]
    return _and(parts)


def has_conditions(groups: Sequence[Mapping]) -> bool:
    return any(g.get("conditions") for g in groups)


# ------------------------------------------------------------------ scopes
def scope_month_text(day_col: str, year: int, month: int, typed_twin: str | None = None) -> Column:
    """four text patterns for one month in mixed date formats.

    ``typed_twin`` names a raw timestamp column the text day was rendered from
    (as 'yyyy-MM-dd'); the implied range on it is added so the scope reaches
    the Parquet scan (row-group / file pruning) without changing the rows."""
    c = F.col(day_col)
    pats = [f"{year}-{month:02d}%", f"{year}.{month:02d}%", f"{year}. {month}.%", f"{year}{month:02d}%"]
    text = _or([c.like(p) for p in pats])
    if typed_twin is None:
        return text
    nxt_y, nxt_m = (year + 1, 1) if month == 12 else (year, month + 1)
    t = F.col(typed_twin)
    lo = F.lit(f"{year}-{month:02d}-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{nxt_y}-{nxt_m:02d}-01 00:00:00").cast("timestamp_ntz")
    return (t >= lo) & (t < hi) & text


def scope_period(day_col: str, start: str | None, end: str | None, typed: bool = False) -> Column:
    """inclusive period bounds, on text (default) or on a typed date."""
    c = F.col(day_col)
    if typed:
        c = F.try_to_date(c, "yyyy-MM-dd")
        lo = F.to_date(F.lit(start)) if start else None
        hi = F.to_date(F.lit(end)) if end else None
    else:
        lo = F.lit(start) if start else None
        hi = F.lit(end) if end else None
    parts = []
    if lo is not None:
        parts.append(c >= lo)
    if hi is not None:
        parts.append(c <= hi)
    return _and(parts)


def scope_channels(channel_col: str, channels: Sequence[str], table: str | None = None) -> Column:
    """IN over requested channels ('DA.x' prefix stripped)."""
    vals = [c.split(".", 1)[1] if table and c.startswith(f"{table}.") else c for c in channels]
    return F.col(channel_col).isin(vals)


def unknown_channels(live_channels: DataFrame, channels: Sequence[str], channel_col: str = "source_channel") -> DataFrame:
    """F11 check: requested channels absent from the live list (must be empty)."""
    spark = live_channels.sparkSession
    req = spark.createDataFrame([(c,) for c in channels], f"{channel_col} string")
    return req.join(live_channels.select(channel_col), channel_col, "left_anti")


def require_channels(live_channels: DataFrame, channels: Sequence[str], channel_col: str = "source_channel") -> None:
    """refuse a request that names channels the table does not have."""
    missing = [r[0] for r in unknown_channels(live_channels, channels, channel_col).collect()]  # at most the requested ones
    if missing:
        raise ConditionError(f"unknown_channels: {sorted(missing)}")


def case_insensitive_eq(column: str, value: str) -> Column:
    """F12 (D2): equality that ignores case, accents and trailing spaces."""
    return F.collate(F.rtrim(F.col(column)), "UNICODE_CI_AI") == F.collate(F.rtrim(F.lit(value)), "UNICODE_CI_AI")


# ------------------------------------------------------------------ spec rewrites
def prune_unknown_conditions(groups: Sequence[Mapping], columns: Sequence[str]) -> list[dict]:
    """F16: read-only requests drop conditions on unknown columns, at any depth; a group keeps its
    known children and goes only when none is left."""
    return [{**g, "conditions": _known(g.get("conditions", []), columns)} for g in groups]


def _known(conditions: Sequence[Mapping], columns: Sequence[str]) -> list[dict]:
    out = []
    for c in conditions:
        if str(c.get("operator", "")).lower() in ("and", "or") and c.get("conditions"):
            kids = _known(c["conditions"], columns)
            if kids:
                out.append({**c, "conditions": kids})
        elif c.get("field") in columns:
            out.append(dict(c))
    return out


def or_recovery(conditions: Sequence[Mapping]) -> list[dict]:
    """conditions sharing (operator, values) on different fields become one OR."""
    buckets: dict[tuple, list[Mapping]] = {}
    order: list[tuple] = []
    for c in conditions:
        key = (str(c.get("operator", "eq")).lower(), tuple(str(v) for v in c.get("values", [])))
        if key not in buckets:
            buckets[key] = []
            order.append(key)
        buckets[key].append(c)
    out: list[dict] = []
    for key in order:
        items = buckets[key]
        fields = {i.get("field") for i in items}
        if len(items) > 1 and len(fields) > 1:
            out.append({"field": "__group__", "operator": "or", "values": list(key[1]), "conditions": [dict(i) for i in items]})
        else:
            out.extend(dict(i) for i in items)
    return out


def match_flags(predicates: Sequence[Mapping]) -> Column:
    """per-row boolean for eq/in/like predicates (all must hold)."""
    parts = []
    for p in predicates:
        c = F.col(p["column"])
        op = p.get("operator", "eq")
        vals = [str(v) for v in p.get("values", [])]
        if op == "eq" and len(vals) == 1:
            parts.append(c.cast("string") == vals[0])
        elif op in ("eq", "in"):
            parts.append(c.cast("string").isin(vals))
        elif op in ("contains", "like"):
            parts.append(c.cast("string").like(vals[0] if "%" in vals[0] else f"%{vals[0]}%"))
    return F.coalesce(_and(parts), F.lit(False))
