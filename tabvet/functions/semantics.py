"""Scalar Column helpers shared by every operator (the D1-D15 decisions).

All helpers return ``pyspark.sql.Column`` expressions built from built-in
functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabvet import fixed_values as FV

DEC = "decimal(18,2)"
DEC6 = "decimal(18,6)"

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- numbers
def num(c: ColumnOrName) -> Column:
    """Late numeric cast of a text cell: commas stripped, blank and bad text -> NULL."""
    return F.nullif(F.replace(col(c), F.lit(","), F.lit("")), F.lit("")).try_cast(DEC)


def is_numeric_literal(value: object) -> bool:
    """Driver-side check on a spec literal (tiny, never data); ``nan`` and ``inf`` are no numbers."""
    try:
        return Decimal(str(value).strip().replace(",", "")).is_finite()
    except InvalidOperation:
        return False


def dec_lit(value: object) -> Column:
    """A numeric literal with its own scale, so nothing of it is cut; beyond 38 digits a double."""
    d = Decimal(str(value).strip().replace(",", ""))
    text = format(d, "f")
    scale = max(0, -d.as_tuple().exponent)
    digits = max(len(d.as_tuple().digits) + max(0, d.as_tuple().exponent), scale + 1)
    return F.lit(text).cast(f"decimal({digits},{scale})" if digits <= 38 else "double")


def metric_out(c: Column, scale: int = 6) -> Column:
    """Engine-neutral metric output (D6): rounded half-up to ``scale`` on the
    exact (decimal) value, then rendered as double."""
    return F.round(c, scale).cast("double")


def parse_number(c: ColumnOrName) -> Column:
    """ETL number: keep digits, '.', '-'; blank/total/'-'/'.' -> NULL; bad -> NULL."""
    t = F.trim(col(c))
    cleaned = F.regexp_replace(t, r"[^0-9.\-]", "")
    return (
        F.when(t.isNull() | (t == "") | (F.lower(t) == "total"), F.lit(None).cast("double"))
        .when(cleaned.isin("", "-", "."), F.lit(None).cast("double"))
        .otherwise(cleaned.try_cast("double"))
    )


# ---------------------------------------------------------------- dates
_DATE_SEP = r"(20\d{2})[-.\s년]+(\d{1,2})[-.\s월]+(\d{1,2})"
_DATE_COMPACT = r"(20\d{2})(\d{2})(\d{2})"


def parse_date_text(c: ColumnOrName) -> Column:
    """First 20yy-m-d (separators - . space 년/월) or 20yymmdd in the text, as 'yyyy-MM-dd'.

    Calendar validity is not checked here (see :func:`parse_date`).
    """
    t = F.trim(col(c))

    def fmt(pattern: str) -> Column:
        y = F.regexp_extract(t, pattern, 1)
        m = F.regexp_extract(t, pattern, 2)
        d = F.regexp_extract(t, pattern, 3)
        return F.when(
            y != "",
            F.concat_ws(
                "-",
                y,
                F.lpad(m.cast("int").cast("string"), 2, "0"),
                F.lpad(d.cast("int").cast("string"), 2, "0"),
            ),
        )

    bad = t.isNull() | (t == "") | (F.lower(t) == "total")
    return F.when(~bad, F.coalesce(fmt(_DATE_SEP), fmt(_DATE_COMPACT)))


def parse_date(c: ColumnOrName) -> Column:
    """Typed date; impossible calendar dates give NULL (quarantined, not aborted)."""
    return F.try_to_date(parse_date_text(c), "yyyy-MM-dd")


def canonical_date(c: ColumnOrName) -> Column:
    """Canonical-table date: ISO 'yyyy-MM-dd' or dotted 'yyyy.MM.dd', else NULL."""
    t = F.trim(col(c))
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
        .when(t.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.try_to_date(t, "yyyy.MM.dd"))
    )


# ---------------------------------------------------------------- text
def normalize_term(c: ColumnOrName, limit: int | None = None) -> Column:
    """Lower-case, all whitespace removed; the whole text is the key. ``limit`` cuts it for display only.

    NFC normalisation is applied by :func:`nfc` first where the text is not
    plain ASCII (ASCII text is already NFC)."""
    whole = F.regexp_replace(F.lower(nfc(col(c))), r"\s+", "")
    return whole if limit is None else F.substring(whole, 1, limit)


# Superset of code points whose NFC form can differ from the input: combining
# marks, conjoining jamo, composition exclusions and singleton decompositions
# (Unicode NFC_Quick_Check = No/Maybe ranges, widened to whole blocks).
NFC_UNSTABLE = (
    r"[\p{M}\u0340-\u0344\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33\u0A36\u0A59-\u0A5E"
    r"\u0B5C\u0B5D\u0F43-\u0FB9\u1100-\u11FF\u1F70-\u1FFF\u2000\u2001\u2126\u212A\u212B\u2329\u232A"
    r"\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


def nfc(c: ColumnOrName) -> Column:
    """NFC normalisation. Text without any NFC-unstable code point (the vast
    majority, including precomposed accented letters and Hangul syllables) is
    returned as is in the JVM. Spark evaluates a Python UDF for every row even
    inside CASE WHEN, so the UDF is fed NULL for those rows: only the few
    unstable strings cross into Python."""
    from tabvet.functions.udfs import nfc_udf

    c = col(c)
    needs = c.rlike(NFC_UNSTABLE)
    return F.when(needs, nfc_udf(F.when(needs, c))).otherwise(c)


def collapse_ws(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def device_group(c: ColumnOrName) -> Column:
    raw = col(c)
    n = F.lower(F.trim(raw))
    return (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(n.isin(*FV.DEVICE_MOBILE) | n.contains("mobile"), F.lit("MO"))
        .when(n.isin(*FV.DEVICE_DESKTOP) | n.contains("desktop"), F.lit("PC"))
        .when(_any_contains(n, FV.DEVICE_TABLET_TOKENS), F.lit("TABLET"))
        .otherwise(F.nullif(F.trim(raw), F.lit("")))
    )


def _any_contains(c: Column, tokens: Iterable[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | c.contains(t)
    return out


def is_conversion(c: ColumnOrName, extra_terms: Sequence[str] = ()) -> Column:
    raw = col(c)
    low = F.lower(raw)
    return _any_contains(low, FV.CONVERSION_TOKENS_LOWER) | _any_contains(
        raw, (*FV.CONVERSION_TOKENS_RAW, *extra_terms)
    )


def event_category(c: ColumnOrName, extra_terms: Sequence[str] = ()) -> Column:
    return F.when(is_conversion(c, extra_terms), F.lit("conversion")).otherwise(col(c))


def semantic_role(c: ColumnOrName) -> Column:
    """Column name -> metric/date/dimension/identity by keyword, first match wins."""
    compact = normalize_term(c)
    out = None
    for role, tokens in FV.SEMANTIC_ROLE_TOKENS:
        cond = _any_contains(compact, tokens)
        out = F.when(cond, F.lit(role)) if out is None else out.when(cond, F.lit(role))
    return out


# ---------------------------------------------------------------- hashes
def row_hash(cols: Sequence[ColumnOrName]) -> Column:
    """SHA-256 row identity over '|'-joined cells, NULL as '' (D12)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols]), 256)


def payload_hash(map_col: ColumnOrName) -> Column:
    """SHA-256 of the key-sorted JSON of a string map."""
    m = col(map_col)
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), 256)


def fingerprint(c: ColumnOrName, n: int = FV.FINGERPRINT_HEX) -> Column:
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, n)


def text_of_decimal(c: ColumnOrName) -> Column:
    """Numbers rendered as text through decimal(18,2), same in every engine."""
    return col(c).cast(DEC).cast("string")


def day_text(c: ColumnOrName) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")
