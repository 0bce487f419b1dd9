"""Oracle SQL fragments for metrics (exact decimal semantics in DuckDB)."""

from __future__ import annotations

from tabvet.sources.tables import num_sql as N


def S(c: str) -> str:
    return f"ROUND(CAST(SUM({N(c)}) AS DOUBLE), 6)"


def _half_up(a: str, b: str) -> str:
    """a / b rounded half-up (away from zero) to an integer, exactly (HUGEINT)."""
    return f"(sign({a}) * sign({b}) * ((2 * abs({a}) + abs({b})) // (2 * abs({b}))))"


def AVG(c: str) -> str:
    """Exact average of decimal(18,2) values at 6 decimals (DuckDB's AVG is a double)."""
    s = f"CAST(SUM({N(c)}) * 100 AS HUGEINT) * 10000"
    k = f"CAST(COUNT({N(c)}) AS HUGEINT)"
    return f"CASE WHEN COUNT({N(c)}) = 0 THEN NULL ELSE CAST({_half_up(s, k)} AS DOUBLE) / 1000000.0 END"


def RATIO(n: str, d: str, fallback: str, pct: bool) -> str:
    """Guarded ratio of two sums, exact at 6 decimals (DuckDB's decimal division is a double)."""
    mul = 100 * 1000000 if pct else 1000000
    a = f"CAST(SUM({N(n)}) * 100 AS HUGEINT) * {mul}"
    b = f"CAST(SUM({N(d)}) * 100 AS HUGEINT)"
    return (f"CASE WHEN SUM({N(d)}) = 0 THEN CAST({fallback} AS DOUBLE) "
            f"ELSE CAST({_half_up(a, b)} AS DOUBLE) / 1000000.0 END")
