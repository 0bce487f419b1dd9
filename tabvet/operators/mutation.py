"""Gated mutation as snapshot jobs.

Parquet has no UPDATE: a change is a new snapshot next to the old one;
``publish`` makes it a version after the backup of every affected row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.operators.overlay import _action_value
from tabvet.fixed_values import (  # fixed values, kept together in fixed_values.py
    PROTECTED_WRITE_COLUMNS,
    PROTECTED_NAME_SUFFIXES,
    PROTECTED_NAME_PARTS,
    LABEL_FIELD_TOKENS,
    LABEL_TEXT_TOKENS,
)


class GateError(RuntimeError):
    pass


# ------------------------------------------------------------------ guards
def refusal(n_conditions: Column, tautology: Column) -> Column:
    """M9: why a write is refused, or NULL: it needs a modification predicate, and never one that is always true."""
    return (F.when(n_conditions == 0, F.lit("update_requires_modification_predicate"))
            .when(tautology, F.lit("update_predicate_tautology")))


def is_tautology(condition: Column) -> Column:
    """Whether a condition's text is ``1 = 1``, however spaced."""
    return F.regexp_replace(condition, r"\s+", "") == "1=1"


def write_refusal(intent: Column, conditions: Column) -> Column:
    """M9 for a table of steps with their conditions as texts; NULL for reads."""
    return F.when(intent == "UPDATE_NUMERIC_VALUE", refusal(F.size(conditions), F.exists(conditions, is_tautology)))


def require_predicate(groups: Sequence[Mapping]) -> None:
    """M9 for one request: raises the refusal."""
    conds = [c for g in groups for c in g.get("conditions", [])]
    if not conds:
        raise GateError("update_requires_modification_predicate")
    for c in conds:
        field, values = "".join(str(c.get("field", "")).split()), [str(v).strip() for v in c.get("values", [])]
        if field == "1=1" or (field == "1" and c.get("operator", "eq") in ("eq", "=") and values in ([], ["1"])):
            raise GateError("update_predicate_tautology")


def is_protected_name(c: Column) -> Column:
    """J8 name rules: the fixed protected set, id-like names and source-channel
    columns are protected (names compared without whitespace, lower-cased)."""
    n = F.lower(F.regexp_replace(c, r"\s+", ""))
    out = c.isin(*PROTECTED_WRITE_COLUMNS) | n.isin("id", "아이디")
    for suf in PROTECTED_NAME_SUFFIXES:
        out = out | n.endswith(suf)
    for part in PROTECTED_NAME_PARTS:
        out = out | n.contains(part)
    return out


def writable_targets(candidates: DataFrame, policy: DataFrame) -> DataFrame:
    """Candidate (target_table, column_name) minus active protected
    columns and protected names. The policy is a bounded dictionary."""
    active = policy.where(F.col("active"))
    if "protection_level" in policy.columns:
        active = active.where(F.col("protection_level") == "block_update")
    active = active.select("target_table", "column_name")
    return candidates.join(F.broadcast(active), ["target_table", "column_name"], "left_anti").where(
        ~is_protected_name(F.col("column_name")))


def unknown_columns(referenced: DataFrame, catalog: DataFrame) -> DataFrame:
    """Referenced (target_table, column_name) missing from the live schema."""
    return referenced.join(catalog.select("target_table", "column_name"), ["target_table", "column_name"], "left_anti")


# ------------------------------------------------------------------ M1
def apply_update(df: DataFrame, where: Column, actions: Sequence[Mapping], protected: Sequence[str] = ()) -> DataFrame:
    """M1: several columns set where the predicate holds -> the next snapshot."""
    bad = [a["target_field"] for a in actions if a["target_field"] in protected]
    if bad:
        raise GateError(f"protected_column_update: {bad}")
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({a["target_field"]: F.when(hit, _action_value(a)).otherwise(F.col(a["target_field"])) for a in actions})


# ------------------------------------------------------------------ M2
def derived_values(df: DataFrame, where: Column, table: str, key: str, value: str, rule_id: str,
                   id_col: str = "row_id", hash_col: str = "source_row_hash") -> DataFrame:
    """M2: (table, row, hash, key, value, rule) for matched rows; raw never changes."""
    return df.where(where).select(
        F.lit(table).alias("target_table"), F.col(id_col).alias("source_row_id"), F.col(hash_col).alias("source_row_hash"),
        F.lit(key).alias("derived_key"), F.lit(value).alias("derived_value"), F.lit(rule_id).alias("rule_id"))


# ------------------------------------------------------------------ M3 / M4
def row_json(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    cols = list(cols or df.columns)
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})


def backup_rows(df: DataFrame, where: Column, scope: str, table: str, existing: DataFrame | None = None,
                id_col: str = "row_id", hash_col: str | None = None) -> DataFrame:
    """M3: full-row JSON per affected row, insert-if-absent by (scope, table, row)."""
    affected = df.where(where)
    rows = affected.select(
        F.lit(scope).alias("backup_scope"), F.lit(table).alias("target_table"), F.col(id_col).alias("source_row_id"),
        (F.col(hash_col) if hash_col else F.lit(None).cast("string")).alias("source_row_hash"),
        row_json(df).alias("before_json"))
    if existing is not None:
        rows = rows.join(existing.select("backup_scope", "target_table", "source_row_id"),
                         ["backup_scope", "target_table", "source_row_id"], "left_anti")
    return rows


def backup_coverage(affected: DataFrame, backups: DataFrame, scope: str, table: str, id_col: str = "row_id") -> DataFrame:
    """One row: affected ids, ids missing an id, backed-up ids, ``complete``.
    Publishing is allowed only when complete (checked before the pointer moves)."""
    ids = affected.select(F.col(id_col).alias("source_row_id"))
    b = backups.where((F.col("backup_scope") == scope) & (F.col("target_table") == table)).select("source_row_id").distinct()
    j = ids.join(b.withColumn("_b", F.lit(1)), "source_row_id", "left")
    return j.agg(
        F.count_distinct("source_row_id").alias("affected_ids"),
        F.count_if(F.col("source_row_id").isNull()).alias("rows_without_id"),
        F.count_distinct(F.when(F.col("_b") == 1, F.col("source_row_id"))).alias("backed_up_ids"),
    ).withColumn("complete", (F.col("rows_without_id") == 0) & (F.col("affected_ids") == F.col("backed_up_ids")))


def rollback(snapshot: DataFrame, backups: DataFrame, columns: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """M4: restore backed-up values by row id (presence decides, NULLs restored too)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in snapshot.dtypes if c in columns)
    b = backups.select(F.col("source_row_id").alias(id_col), F.from_json("before_json", schema).alias("_old"))
    j = snapshot.join(b, id_col, "left")
    return j.withColumns({c: F.when(F.col("_old").isNotNull(), F.col("_old").getField(c)).otherwise(F.col(c)) for c in columns}).drop("_old")


# ------------------------------------------------------------------ M5
def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: Sequence[str], update_cols: Sequence[str]) -> DataFrame:
    """M5: ON DUPLICATE KEY UPDATE -- matching keys take only ``update_cols``
    from the incoming rows; every other column keeps the existing value."""
    key = list(key)
    cols = [c for c in existing.columns if c not in key]
    e = existing.select(*key, *[F.col(c).alias(f"_e_{c}") for c in cols], F.lit(True).alias("_e"))
    i = incoming.select(*key, *[F.col(c).alias(f"_i_{c}") for c in cols], F.lit(True).alias("_i"))
    j = e.join(i, key, "full_outer")
    out = []
    for c in cols:
        if c in update_cols:
            out.append(F.when(F.col("_i").isNotNull(), F.col(f"_i_{c}")).otherwise(F.col(f"_e_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_e").isNotNull(), F.col(f"_e_{c}")).otherwise(F.col(f"_i_{c}")).alias(c))
    return j.select(*key, *out)


# ------------------------------------------------------------------ M6 / M7 / M8 / M10
def change_audit(delta_long: DataFrame, run_id: str, table: str) -> DataFrame:
    """M6: one audit row per changed field."""
    return delta_long.select(F.lit(run_id).alias("run_id"), F.lit(table).alias("target_table"),
                             F.col("source_row_id"), F.col("column_name").alias("field_name"),
                             F.col("old_value").alias("before_value"), F.col("new_value").alias("after_value"))


def gate_check(previews: DataFrame, approvals: DataFrame, key: Sequence[str]) -> DataFrame:
    """M7: execution allowed only when validation passed, the preview is
    pending confirmation, it is approved, and both fingerprints match;
    ``refused_by`` names the first of these that fails."""
    j = previews.join(approvals, list(key), "left")
    checks = {
        "validation": F.col("validation_status") == "passed",
        "preview": F.col("preview_status") == "pending_user_confirmation",
        "approval": F.col("approved"),
        "sql_fingerprint": F.col("approved_sql_fingerprint") == F.col("sql_fingerprint"),
        "preview_fingerprint": F.col("approved_preview_fingerprint") == F.col("preview_fingerprint"),
    }
    refused = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return j.select(*key, refused.isNull().alias("can_execute"), refused.alias("refused_by"))


def overlay_update_block(steps: DataFrame, pred_col: str = "predicate_columns", overlay_col: str = "overlay_columns") -> DataFrame:
    """M8: an UPDATE whose predicate uses an overlaid column is refused."""
    unsafe = F.array_sort(F.array_intersect(F.col(pred_col), F.col(overlay_col)))
    blocked = (F.col("intent_type") == "UPDATE_NUMERIC_VALUE") & (F.size(unsafe) > 0)
    return steps.select("*", blocked.alias("blocked"), F.when(blocked, F.array_join(unsafe, ",")).alias("unsafe_columns"))


def route_label_updates(actions: DataFrame, live_columns: DataFrame, text_col: str = "text") -> DataFrame:
    """An update whose target looks like a label, is no live column and
    whose text has a labelling word becomes a derived value (M2)."""
    t = F.col(text_col)
    text_hit = F.lit(False)
    for tok in LABEL_TEXT_TOKENS:
        text_hit = text_hit | t.contains(tok)
    target = F.trim(F.regexp_replace(F.col("target_field"), r"\s+", " "))
    label_like = F.lit(False)
    for tok in LABEL_FIELD_TOKENS:
        label_like = label_like | target.contains(tok)
    live = live_columns.select(F.col("column_name").alias("target_field")).distinct().withColumn("_live", F.lit(True))
    j = actions.join(F.broadcast(live), "target_field", "left")
    route = text_hit & label_like & F.col("_live").isNull()
    return j.select(*actions.columns, F.when(route, F.lit("derived_value")).otherwise(F.lit("raw_update")).alias("route"))
