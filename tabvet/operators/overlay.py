"""Preview deltas and the what-if overlay.

Raw data is never touched: a later step reads ``raw LEFT JOIN overlay`` where
the overlay holds, per source row, one map of the latest approved values of
its dependency ancestors. One join covers any number of changed columns.
Whether a column is overlaid is decided by *presence* of its key in the map,
so an overlay to NULL is honoured.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.semantics import DEC


def ntz(ts: dt.datetime) -> Column:
    """Zone-independent timestamp literal (wall time, whatever the session zone)."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")

DELTA_VALUE = "struct<old:string,new:string>"


# ------------------------------------------------------------------ previews (O1, O2)
def _action_value(action: Mapping) -> Column:
    op = str(action.get("operation", "set_literal")).lower()
    if op == "set_zero":
        return F.lit("0")
    if op in ("set_literal", "set_value"):
        v = action.get("value")
        return F.lit(None).cast("string") if v is None else F.lit(str(v))
    raise ValueError(f"Unsupported action operation: {op}")


def preview_update_delta(df: DataFrame, where: Column, actions: Sequence[Mapping], id_col: str = "row_id") -> DataFrame:
    """O1: per affected row, before/after maps of the action columns and the
    delta map {column: {old, new}}; computed and written by executors."""
    targets = [a["target_field"] for a in actions]
    before = F.create_map(*[x for t in targets for x in (F.lit(t), F.col(t))])
    after = F.create_map(*[x for a in actions for x in (F.lit(a["target_field"]), _action_value(a))])
    delta = F.create_map(*[
        x for a in actions
        for x in (F.lit(a["target_field"]), F.struct(F.col(a["target_field"]).alias("old"), _action_value(a).alias("new")))
    ])
    return df.where(where).select(
        F.col(id_col).alias("source_row_id"), before.alias("before"), after.alias("after"), delta.alias("delta"),
        F.lit("preview_update").alias("delta_type"),
    )


def preview_derived_delta(df: DataFrame, where: Column, key: str, value: str, id_col: str = "row_id") -> DataFrame:
    """O2: before {key: NULL}, after {key: value} for every matched row."""
    return df.where(where).select(
        F.col(id_col).alias("source_row_id"),
        F.create_map(F.lit(key), F.lit(None).cast("string")).alias("before"),
        F.create_map(F.lit(key), F.lit(value)).alias("after"),
        F.lit("preview_derived").alias("delta_type"),
    )


def explode_delta(delta: DataFrame, keep: Sequence[str] = ("source_row_id", "delta_type")) -> DataFrame:
    return delta.select(*keep, F.explode("delta").alias("column_name", "d")).select(
        *keep, "column_name", F.col("d.old").alias("old_value"), F.col("d.new").alias("new_value"))


def unexpired(as_of: dt.datetime) -> Column:
    """A delta without an expiry never expires."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > ntz(as_of))


# ------------------------------------------------------------------ delta log state (O3)
def delta_log_current(events: DataFrame, as_of: dt.datetime, key: str = "delta_item_id") -> DataFrame:
    """O3: latest event per delta item (append-only log, latest wins); items
    replaced by a re-preview and expired items are dropped."""
    cols = [c for c in events.columns if c not in (key, "seq")]
    latest = events.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("seq")).alias("e")).select(key, "e.*")
    return latest.where((F.col("status") != "replaced") & unexpired(as_of))


# ------------------------------------------------------------------ overlay
def ancestor_deltas(
    delta: DataFrame, closure: DataFrame | Sequence[str], plan_id: str, current_step: str, current_order: int,
    as_of: dt.datetime, target_table: str,
) -> DataFrame:
    """Approved, unexpired deltas of ``target_table`` whose step is a dependency
    ancestor of the current step and comes before it. ``closure`` is the plan-table closure
    (L1) or, for a plan given as a spec, its ancestor keys. The ancestor list
    is bounded by the plan size, so it is broadcast into a semi join."""
    if isinstance(closure, DataFrame):
        anc = closure.where((F.col("plan_id") == plan_id) & (F.col("step_key") == current_step)).select(
            F.col("ancestor_key").alias("step_key")).distinct()
    else:
        anc = delta.sparkSession.createDataFrame([(k,) for k in closure], "step_key string")
    d = delta.where(
        (F.col("linked_plan_id") == plan_id) & (F.col("delta_status") == "approved")
        & (F.col("target_table") == target_table) & unexpired(as_of) & (F.col("step_order") < current_order)
    )
    return d.join(F.broadcast(anc), "step_key", "left_semi")


def latest_delta(deltas: DataFrame) -> DataFrame:
    """Per (row, column) the value of the highest step_order, then highest
    delta id -- ``max_by`` over a struct key, no sort."""
    long = deltas.select("source_row_id", "step_key", "step_order", "delta_item_id",
                         F.explode("after").alias("column_name", "new_value"))
    order = F.struct("step_order", "delta_item_id")
    return long.groupBy("source_row_id", "column_name").agg(
        F.max_by(F.struct("new_value", "step_key", "delta_item_id"), order).alias("w")
    ).select("source_row_id", "column_name", "w.new_value", "w.step_key", "w.delta_item_id")


def overlay_map(latest: DataFrame) -> DataFrame:
    """One row per source row: map<column, latest value> (bounded by the column count)."""
    return latest.groupBy("source_row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "new_value"))).alias("overlay"))


def join_overlay(raw: DataFrame, overlay: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Raw LEFT JOIN per-row overlay map. The map is grouped by row id, so its
    side of the join is partitioned already; whether it is broadcast, the engine
    decides from its real bytes."""
    return raw.join(overlay.withColumnRenamed("source_row_id", id_col), id_col, "left")


def effective(column: str, overlay_col: str = "overlay") -> Column:
    """Overlaid value when the map has the key (even if NULL), else raw."""
    m = F.col(overlay_col)
    return F.when(F.coalesce(F.map_contains_key(m, column), F.lit(False)), F.element_at(m, column)).otherwise(F.col(column))


def apply_overlay(joined: DataFrame, columns: Sequence[str], overlay_col: str = "overlay") -> DataFrame:
    return joined.withColumns({c: effective(c, overlay_col) for c in columns}).drop(overlay_col)


def overlay_aggregate(raw: DataFrame, overlay: DataFrame, columns: Sequence[str], where_raw: Column | None,
                      group_by: Sequence[str], aggs: Sequence[Column], id_col: str = "row_id") -> DataFrame:
    """WHERE evaluated on raw values (pushed into the scan), aggregate over
    effective values."""
    base = raw.where(where_raw) if where_raw is not None else raw
    eff = apply_overlay(join_overlay(base, overlay, id_col), columns)
    return eff.groupBy(*group_by).agg(*aggs)


def overlay_detail(raw: DataFrame, overlay: DataFrame, columns: Sequence[str], where_effective: Column | None,
                   id_col: str = "row_id") -> DataFrame:
    """Detail rows over effective values, WHERE applied after the overlay."""
    eff = apply_overlay(join_overlay(raw, overlay, id_col), columns)
    if where_effective is not None:
        eff = eff.where(where_effective)
    return eff.orderBy(id_col)


def semi_prior_delta(df: DataFrame, derived: DataFrame, keys: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """Rows whose id is among the delta rows carrying any of ``keys``; ``derived`` are
    the deltas in scope (``ancestor_deltas``)."""
    ids = derived.where(F.arrays_overlap(F.map_keys("after"), F.array(*[F.lit(k) for k in keys]))).select(
        F.col("source_row_id").alias(id_col))
    return df.join(ids, id_col, "left_semi")


def derived_scope(df: DataFrame, derived: DataFrame, key: str, id_col: str = "row_id") -> DataFrame:
    """Rows of the prior derived steps in scope, with the latest label of each as a group key."""
    labels = (
        derived.where(F.map_contains_key("after", key)).groupBy(F.col("source_row_id").alias(id_col))
        .agg(F.max_by(F.element_at("after", key), F.struct("step_order", "delta_item_id")).alias(key))
    )
    return df.join(labels, id_col, "inner")


# ------------------------------------------------------------------ preview bundle
def preview_bundle(df: DataFrame, where: Column, sample_cols: Sequence[str], order_by: str = "row_id", n: int = 2) -> DataFrame:
    """Affected count plus a sample of ``n`` rows ordered by id, in one job:
    the count is observed on the rows flowing into the top-n, so only the
    ``n`` sample rows and one number reach the driver."""
    from pyspark.sql import Observation

    obs = Observation("preview_bundle")
    matched = df.where(where).observe(obs, F.count(F.lit(1)).alias("n"))
    top = matched.orderBy(order_by).limit(n).select(*sample_cols)
    rows = top.collect()  # at most n rows
    count = int(obs.get["n"])
    out = df.sparkSession.createDataFrame(rows, top.schema)
    return out.withColumns({"affected_count": F.lit(count).cast("long"), "limited": F.lit(count > n)})


def hash60(text: Column) -> Column:
    """60-bit integer from SHA-256 (order-free fingerprints combine these with XOR)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def delta_fingerprint(delta_long: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a full delta (row count + XOR of row hashes)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols])
    return delta_long.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hash60(text)).alias("fp"))


def compare_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (old_n, old_fp, new_n, new_fp, changed) from two fingerprint rows."""
    both = old.withColumn("v", F.lit("old")).unionByName(new.withColumn("v", F.lit("new")))
    pick = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    out = both.agg(pick("old", "n").alias("old_n"), pick("old", "fp").alias("old_fp"),
                   pick("new", "n").alias("new_n"), pick("new", "fp").alias("new_fp"))
    changed = (F.col("old_n") != F.col("new_n")) | ~F.col("old_fp").eqNullSafe(F.col("new_fp"))
    return out.withColumn("changed", changed)


def num_text(c: Column) -> Column:
    return c.cast(DEC)
