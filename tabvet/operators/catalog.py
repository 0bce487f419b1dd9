"""Profiling catalogs.

Every catalog is a single pass over the data: the wide table is unpivoted
into (column_name, value) pairs, and ``groupBy(column_name, value)`` gets a
map-side partial aggregate, so a hot value costs one row per partition in
the shuffle, never a group held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions.semantics import normalize_term, semantic_role


def unpivot_text(df: DataFrame, columns: Sequence[str] | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """Wide -> long (``ids..., column_name, value``) with every value as text."""
    columns = list(columns or [c for c in df.columns if c not in ids])
    casted = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return casted.unpivot(list(ids), columns, "column_name", "value")


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None, non_blank: bool = True) -> DataFrame:
    """(column_name, value, frequency) over non-NULL (and by default non-blank) cells.

    Blank values are dropped *after* the aggregate, so distinct counts and top
    values computed from the same table share one identical shuffle, which
    Spark reuses when both feed one plan (a single catalog pass)."""
    long = unpivot_text(df, columns).where(F.col("value").isNotNull())
    freq = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("frequency"))
    return freq.where(F.trim("value") != "") if non_blank else freq


def column_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Exact COUNT(DISTINCT) of every column (``approx`` uses HLL++)."""
    columns = list(columns or df.columns)
    if approx:
        long = unpivot_text(df, columns).where(F.col("value").isNotNull())
        counts = long.groupBy("column_name").agg(F.approx_count_distinct("value").alias("distinct_count"))
    else:
        counts = value_frequencies(df, columns, non_blank=False).groupBy("column_name").agg(
            F.count(F.lit(1)).alias("distinct_count"))
    # columns that are NULL everywhere still get a row (the list is schema metadata)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(counts, "column_name", "left").select(
        "column_name", F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count")
    )


def distinct_channels(df: DataFrame, column: str = "source_channel", limit: int | None = None) -> DataFrame:
    """All distinct non-empty channels, sorted; ``limit`` cuts the list for a report."""
    c = F.col(column)
    out = df.select(c).where(c.isNotNull() & (F.trim(c) != "")).distinct().orderBy(column)
    return out if limit is None else out.limit(limit)


def top_values(freq: DataFrame, n: int = FV.VALUES_PER_COLUMN) -> DataFrame:
    """Top-n values per column by frequency desc, value asc.

    ``row_number() <= n`` lets Spark insert a partial window group limit
    before the shuffle, so a column with millions of distinct values only
    sends n rows per partition to its window task."""
    w = Window.partitionBy("column_name").orderBy(F.col("frequency").desc(), F.col("value").asc())
    return freq.withColumn("value_rank", F.row_number().over(w).cast("long")).where(F.col("value_rank") <= n)


def column_catalog(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Table, column, normalised name, semantic role, distinct count."""
    counts = column_distinct_counts(df, columns)
    return counts.select(
        F.lit(table).alias("target_table"),
        "column_name",
        normalize_term("column_name").alias("normalized_name"),
        semantic_role("column_name").alias("semantic_role"),
        "distinct_count",
    )


def value_catalog(
    df: DataFrame,
    table: str,
    n: int = FV.VALUES_PER_COLUMN,
    skip: Sequence[str] = FV.SKIP_VALUE_COLUMNS,
) -> DataFrame:
    """Top-n non-blank values per column (identity columns skipped).

    On a normalised-key collision the value processed last -- the rarest,
    i.e. the highest rank -- wins with its own frequency (no summing)."""
    columns = [c for c in df.columns if c not in skip]
    top = top_values(value_frequencies(df, columns), n).withColumn("normalized_value", normalize_term("value"))
    won = top.groupBy("column_name", "normalized_value").agg(
        F.max_by(F.struct(F.col("value").alias("raw_value"), "frequency"), F.col("value_rank")).alias("w")
    )
    return won.select(F.lit(table).alias("target_table"), "column_name", "normalized_value", "w.raw_value", "w.frequency")


def unresolved_terms(terms: DataFrame, catalog_columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """Request terms that match neither a live column nor an alias."""
    cols = catalog_columns.select(normalize_term("column_name").alias("k"))
    als = aliases.select(normalize_term("user_term").alias("k"))
    known = cols.unionByName(als).distinct()
    t = terms.withColumn("k", normalize_term("term"))
    return t.join(known, "k", "left_anti").drop("k")


def catalog_candidates(column_cands: DataFrame, value_cands: DataFrame) -> DataFrame:
    """Column candidates union value candidates, distinct on identity."""
    both = column_cands.unionByName(value_cands, allowMissingColumns=True)
    return both.dropDuplicates(["kind", "target_table", "column_name", "candidate"])
