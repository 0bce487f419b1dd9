"""Projection / normalisation operators.

Everything is a Column expression or a narrow projection; the only shuffle
here is the (bounded-dictionary) field-mapping join of P10 and the single
``count_if`` pass of P17.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet import fixed_values as FV
from tabvet.functions.semantics import DEC6, num, parse_date


def merge_alias_columns(*sources: str) -> Column:
    """First non-empty of several source columns; '' if one is present but
    blank; NULL if none is present."""
    firsts = [F.nullif(F.col(s), F.lit("")) for s in sources]
    present = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in sources])
    return F.coalesce(*firsts, F.when(present, F.lit("")))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Differently shaped inputs into one table (missing columns -> NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def payload_map(df: DataFrame, header_to_column: Mapping[str, str]) -> Column:
    """Row payload as map<header, value> (headers are unique)."""
    return F.create_map(*[x for h, c in header_to_column.items() for x in (F.lit(h), F.col(c))])


def canonical_payload(
    payload_long: DataFrame,
    key_cols: Sequence[str],
    mapping: Sequence[tuple[str, str]] = FV.SOURCE_FIELD_CODES,
) -> DataFrame:
    """P10: payload entries renamed to standard field codes; per code the first
    non-empty value in mapping order wins. Input: (keys..., header, value)."""
    spark = payload_long.sparkSession
    mp = spark.createDataFrame([(h, c, i) for i, (h, c) in enumerate(mapping)], "header string, field_code string, map_order int")
    v = F.trim("value")
    hits = payload_long.where(F.col("value").isNotNull() & (v != "")).join(F.broadcast(mp), "header")
    return hits.groupBy(*key_cols, "field_code").agg(F.min_by(v, F.col("map_order")).alias("value"))


def canonical_payload_columns(m: Column, mapping: Sequence[tuple[str, str]] = FV.SOURCE_FIELD_CODES) -> dict[str, Column]:
    """P10, narrow form: per field code the first non-empty mapped header in
    mapping order -- a per-row expression, no explode and no shuffle."""
    by_code: dict[str, list[str]] = {}
    for h, code in mapping:
        by_code.setdefault(code, []).append(h)
    return {
        code: F.coalesce(*[F.nullif(F.trim(F.try_element_at(m, F.lit(h))), F.lit("")) for h in hs])
        for code, hs in by_code.items()
    }


def canonical_report_date(report_date: Column, start_date: Column) -> Column:
    """report_date = date, else start date, parsed by P7 (text 'yyyy-MM-dd')."""
    d = parse_date(F.coalesce(F.nullif(report_date, F.lit("")), start_date))
    return F.date_format(d, "yyyy-MM-dd")


def canonical_date(c: Column) -> Column:
    """P11 date: ISO or dotted ('2024. 5. 3.' style) text -> DATE, else NULL."""
    t = F.nullif(c, F.lit(""))
    dotted = F.regexp_replace(F.regexp_replace(t, r"\s+", ""), r"^\.+|\.+$", "")
    return (
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
        .when(t.rlike(r"^[0-9]{4}\.\s*[0-9]{1,2}\.\s*[0-9]{1,2}\.?$"), F.try_to_date(dotted, "yyyy.M.d"))
    )


def canonical_device(*cols: str) -> Column:
    raw = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])
    low = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when(low.isin(*FV.CANON_DEVICE_MOBILE), F.lit("mobile"))
        .when(low.isin(*FV.CANON_DEVICE_DESKTOP), F.lit("desktop"))
        .when(low.isin(*FV.CANON_DEVICE_TABLET), F.lit("tablet"))
        .otherwise(F.nullif(raw, F.lit("")))
    )


def canonical_rows(df: DataFrame, m: Mapping[str, object]) -> DataFrame:
    """Typed canonical rows. ``m`` maps canonical fields to source columns
    (lists mean "first non-empty")."""

    def first(names) -> Column:
        names = [names] if isinstance(names, str) else list(names)
        return F.nullif(F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names]), F.lit(""))

    out = [F.col("row_id").alias("source_row_id"), F.col("source_channel")]
    if "report_date" in m:
        out.append(canonical_date(F.col(m["report_date"])).alias("report_date"))
    if "device" in m:
        dev = m["device"]
        out.append(canonical_device(*([dev] if isinstance(dev, str) else dev)).alias("device_type_std"))
    for name in ("campaign_name", "ad_group_name", "creative_name", "event_name"):
        if name in m:
            out.append(first(m[name]).alias(name))
    for name in ("impressions", "clicks", "cost", "sessions"):
        if name in m:
            out.append(num(m[name]).alias(name))
    if "ctr" in m:
        out.append(F.nullif(F.regexp_replace(F.col(m["ctr"]), ",", ""), F.lit("")).try_cast(DEC6).alias("ctr"))
    return df.select(*out)


def additional_metrics(payload: Column, consumed: Sequence[str]) -> Column:
    """Payload minus mapped fields and blank values."""
    cons = F.array(*[F.lit(c) for c in consumed]) if consumed else F.array().cast("array<string>")
    return F.map_filter(payload, lambda k, v: ~F.array_contains(cons, k) & (F.trim(v) != ""))


#: Columns that the keys of maps may become; more are refused, as one projection holds them all.
MAX_KEY_COLUMNS = 2_000


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs and maps -> flat columns named ``a.b.c``.

    Fields stand in their order.  The keys of a map are those of any row, found by one
    distributed union per level of nesting, and stand in the order of their texts; a row
    without a key has NULL there.  Maps without a key in any row give no column."""

    def is_map(dtype: T.DataType) -> bool:
        return isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType)

    def opened(path: tuple, ref: Column, dtype: T.DataType) -> list[tuple]:
        """(path, column, type) of the leaves below structs; maps are leaves for now."""
        if isinstance(dtype, T.StructType):
            return [leaf for f in dtype.fields for leaf in opened((*path, f.name), ref.getField(f.name), f.dataType)]
        return [(path, ref, dtype)]

    leaves = [leaf for f in df.schema.fields for leaf in opened((f.name,), F.col(f"`{f.name}`"), f.dataType)]
    while maps := [i for i, (_, _, dtype) in enumerate(leaves) if is_map(dtype)]:
        found = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("leaf"), F.map_keys(leaves[i][1]).alias("keys")) for i in maps])).alias("m"))
        keys: dict[int, list[str]] = {}
        for r in found.select("m.leaf", F.explode("m.keys").alias("key")).distinct().orderBy("leaf", "key").limit(MAX_KEY_COLUMNS + 1).collect():
            keys.setdefault(r.leaf, []).append(r.key)
        if sum(map(len, keys.values())) > MAX_KEY_COLUMNS:
            raise ValueError(f"maps have more than {MAX_KEY_COLUMNS} keys")
        leaves = [
            part
            for i, (path, ref, dtype) in enumerate(leaves)
            for part in ([leaf for k in keys.get(i, []) for leaf in opened((*path, k), F.try_element_at(ref, F.lit(k)), dtype.valueType)]
                         if is_map(dtype) else [(path, ref, dtype)])
        ]
    return df.select(*[ref.alias(sep.join(path)) for path, ref, _ in leaves])


def dim_date_attrs(days: DataFrame, day_col: str = "day") -> DataFrame:
    """One row per distinct date plus the unknown member (id 0)."""
    d = F.to_date(F.col(day_col))
    known = (
        days.select(F.col(day_col)).where(F.col(day_col).isNotNull()).distinct()
        .select(
            F.date_format(d, "yyyyMMdd").cast("int").alias("date_id"),
            F.col(day_col).alias("date_value"),
            F.year(d).alias("year_no"),
            F.month(d).alias("month_no"),
            F.concat(F.expr(f"extract(YEAROFWEEK FROM to_date({day_col}))").cast("string"), F.lit("-W"),
                     F.lpad(F.weekofyear(d).cast("string"), 2, "0")).alias("week_label"),
            (F.weekday(d) + 1).alias("weekday_no"),
            F.date_format(d, "EEEE").alias("weekday_name"),
        )
    )
    spark = days.sparkSession
    unknown = spark.createDataFrame(
        [(0, "1000-01-01", None, None, "unknown", None, "unknown")],
        "date_id int, date_value string, year_no int, month_no int, week_label string, weekday_no int, weekday_name string",
    )
    return known.unionByName(unknown)


def drop_empty_columns(df: DataFrame, always_keep: Sequence[str] = ("row_index",), hide_like: str = "hash") -> DataFrame:
    """Hide hash columns and columns blank in every row; keep ``always_keep``
    and aggregate-named columns. One aggregate pass decides the projection."""
    agg_words = ("count", "sum", "avg", "ctr", "rate", "total")
    cand = [c for c in df.columns if hide_like not in c.lower()]
    stats = df.agg(*[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in cand]).first()
    keep = [
        c for c in cand
        if c in always_keep or any(w in c.lower() for w in agg_words) or (stats[c] or 0) > 0
    ]
    return df.select(*keep)


def mask_sample(df: DataFrame, allow: Sequence[str], order_by: Sequence[str], n: int = 3) -> DataFrame:
    """Only allow-listed columns of a deterministic sample."""
    return df.orderBy(*order_by).select(*[c for c in allow if c in df.columns]).limit(n)
