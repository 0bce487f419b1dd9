"""Header-name functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions.semantics import ColumnOrName, col, collapse_ws

_ID_PATTERN = r"(?i)(^|[^0-9A-Za-z])id($|[^0-9A-Za-z])"


def header_key(c: ColumnOrName) -> Column:
    """Whitespace removed, lower-cased (alias lookup key)."""
    return F.lower(F.regexp_replace(col(c), r"\s+", ""))


def is_id_header(c: ColumnOrName) -> Column:
    base = col(c)
    return header_key(base).contains("아이디") | base.rlike(_ID_PATTERN)


def canonical_header(c: ColumnOrName, aliases: dict[str, list[str]] = FV.HEADER_ALIASES) -> Column:
    """Collapse whitespace; id-like headers kept; alias sets -> canonical name."""
    base = collapse_ws(c)
    key = header_key(base)
    expr = F.when(is_id_header(base), base)
    for canon, names in aliases.items():
        expr = expr.when(key.isin(list(names)), F.lit(canon))
    return expr.otherwise(base)


def strip_ws(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def safe_base(c: ColumnOrName, max_len: int = 64, keep: int = 55) -> Column:
    """P2 (per name): control chars -> space, trim, blank -> 'unnamed',
    'source_channel' -> 'raw_source_channel', over-long -> prefix + '_' + sha1[:8]."""
    b = strip_ws(F.regexp_replace(col(c), r"[\x00-\x1f\x7f]", " "))
    b = F.when(b == "", F.lit("unnamed")).when(F.lower(b) == "source_channel", F.lit("raw_source_channel")).otherwise(b)
    return F.when(
        F.length(b) > max_len, F.concat(F.substring(b, 1, keep), F.lit("_"), F.substring(F.sha1(b), 1, 8))
    ).otherwise(b)


def safe_identifiers(df: DataFrame, group: str, pos: str, raw: str, out: str = "safe_name", max_len: int = 64) -> DataFrame:
    """Case-insensitive de-duplication inside each header group: a name that is
    taken, also by a numbered one, gets the first free number from ``_2`` on.

    Each name depends on all names before it, so the cells of a header row are
    folded in order; a header row is bounded, so no group grows with the data.
    A name is first tried with the number after those of its own base; all numbers
    are tried only if another name holds that one."""
    def numbered(base: Column, n: Column) -> Column:
        mark = F.concat(F.lit("_"), n.cast("string"))
        return F.when(n == 1, base).otherwise(F.concat(F.substring(base, F.lit(1), F.lit(max_len) - F.length(mark)), mark))

    def first_free(used: Column, base: Column) -> Column:
        """The name and its lower-case forms with and without the number; a NULL cell has a NULL name and takes none."""
        def taken(name: Column) -> Column:
            return F.coalesce(F.array_contains(used["low"], F.lower(name)), F.lit(False))

        def of(low: Column) -> Column:
            # Earlier cells of the same base took different numbers, and every number below theirs was taken.
            n = F.size(F.filter(used, lambda u: u["base"] == low)) + 1
            # One more than names: a long base that ends like a number may be its own numbered form.
            tries = F.transform(F.sequence(F.lit(1), F.size(used) + 2), lambda k: numbered(base, k))
            free = F.get(F.filter(tries, lambda t: ~taken(t)), F.lit(0))
            direct = numbered(base, n)
            fits = (n == 1) | (F.length(base) + F.length(n.cast("string")) < max_len)
            name = F.when(fits & ~taken(direct), direct).otherwise(free)
            return F.transform(F.array(name), lambda x: F.struct(x.alias("name"), F.lower(x).alias("low"), low.alias("base")))
        return F.flatten(F.transform(F.array(F.lower(base)), of))

    cells = df.select(group, F.struct(F.col(pos).alias("_pos"), safe_base(raw, max_len).alias("_base"), F.struct(*df.columns).alias("_row")).alias("_cell"))
    rows = cells.groupBy(group).agg(F.array_sort(F.collect_list("_cell"), lambda a, b: F.signum((a["_pos"] - b["_pos"]).cast("double")).cast("int")).alias("_cells"))
    names = F.aggregate("_cells", F.array().cast("array<struct<name:string,low:string,base:string>>"),
                        lambda used, c: F.concat(used, first_free(used, c["_base"])))
    return rows.withColumn("_names", names).select(F.explode(F.arrays_zip("_cells", "_names")).alias("_x")).select(
        "_x._cells._row.*", F.col("_x._names.name").alias(out))


def unique_headers(df: DataFrame, group: str, pos: str, raw: str, out: str = "header") -> DataFrame:
    """Trim; blank -> unnamed_<pos>; repeated names -> name_2, name_3 (case-sensitive)."""
    base = strip_ws(raw)
    base = F.when(base == "", F.concat(F.lit("unnamed_"), F.col(pos).cast("string"))).otherwise(base)
    b = df.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy(group, "_base").orderBy(pos))
    b = b.withColumn("_n", n)
    return b.withColumn(
        out, F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_n").cast("string")))
    ).drop("_base", "_n")
