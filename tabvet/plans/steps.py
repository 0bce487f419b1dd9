"""Linked step plans as DataFrames.

A plan is a set of step rows ``(plan_id, step_key, step_order, intent_type,
dependency_type, depends_on array<string>, ...)``.  Every operator is
partitioned by ``plan_id``: a plan holds tens of steps, so windows and joins
per plan stay small while the number of plans can grow without bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.session import checkpoint
from tabvet.fixed_values import (  # fixed values, kept together in fixed_values.py
    DEPENDENCY_TERMS,
)


MUTATING = ("UPDATE_NUMERIC_VALUE", "ADD_DERIVED_COLUMN")
READING = ("SELECT_DETAIL", "SELECT_AGGREGATE")

def plan_edges(steps: DataFrame) -> DataFrame:
    """(plan_id, step_key, dep_key), one row per declared dependency."""
    return steps.select("plan_id", "step_key", F.explode("depends_on").alias("dep_key")).distinct()


def transitive_closure(edges: DataFrame, max_rounds: int = 256) -> DataFrame:
    """L1: (plan_id, step_key, ancestor_key) for every transitive dependency.

    Semi-naive iteration: each round joins only the newly found pairs to the
    edges and removes pairs already known, so cycles (self dependencies)
    terminate. Each round's result is checkpointed to the shared checkpoint
    folder, which keeps the lineage short and survives executor loss."""
    e = edges.select("plan_id", "step_key", F.col("dep_key").alias("ancestor_key")).distinct()
    e = checkpoint(e)
    known, frontier = e, e
    step = checkpoint(edges.select("plan_id", F.col("step_key").alias("mid"), F.col("dep_key").alias("next_key")).distinct())
    for _ in range(max_rounds):
        nxt = (
            frontier.withColumnRenamed("ancestor_key", "mid").join(step, ["plan_id", "mid"])
            .select("plan_id", "step_key", F.col("next_key").alias("ancestor_key"))
            .distinct()
        )
        # each round's new pairs are materialised; the known set is a union of
        # those checkpointed pieces, so its lineage never re-runs a round
        new = checkpoint(nxt.join(known, ["plan_id", "step_key", "ancestor_key"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        frontier = new
    raise RuntimeError("dependency closure did not converge; plan deeper than max_rounds")


def steps_to_invalidate(closure: DataFrame, steps: DataFrame, changed_step: str, mode: str = "dependents") -> DataFrame:
    """L2: steps to re-check when ``changed_step`` changes.

    ``dependents``: the step and all transitive dependents (the warning).
    ``order``: the step and every later step by order (what approve/cancel does)."""
    me = steps.where(F.col("step_key") == changed_step).groupBy("plan_id").agg(F.min("step_order").alias("my_order"))
    if mode == "dependents":
        deps = closure.where(F.col("ancestor_key") == changed_step).select("plan_id", "step_key")
        own = me.select("plan_id", F.lit(changed_step).alias("step_key"))
        return deps.unionByName(own).distinct()
    if mode == "order":
        later = steps.join(me, "plan_id").where(F.col("step_order") >= F.col("my_order")).select("plan_id", "step_key")
        return later.distinct()
    raise ValueError(mode)


def step_plan_validation(steps: DataFrame) -> DataFrame:
    """L3: one row per problem: duplicate id, self dependency, missing
    dependency, order violation, dependent without dependencies, and the
    independent-with-dependencies warning. Single-step plans are not checked."""
    n_steps = steps.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    s = steps.join(n_steps, "plan_id").where(F.col("n") > 1).drop("n")
    dup = (
        s.groupBy("plan_id", "step_key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
        .select("plan_id", F.lit(None).cast("int").alias("step_order"), "step_key",
                F.lit("linked_step_duplicate_id").alias("error_code"), F.lit(None).cast("string").alias("detail"),
                F.lit("error").alias("severity"))
    )
    selfdep = s.where(F.array_contains("depends_on", F.col("step_key"))).select(
        "plan_id", "step_order", "step_key", F.lit("linked_step_self_dependency").alias("error_code"),
        F.lit(None).cast("string").alias("detail"), F.lit("error").alias("severity"))
    dep = s.select("plan_id", "step_order", "step_key", F.explode("depends_on").alias("dep_key"))
    keys = s.select("plan_id", F.col("step_key").alias("dep_key"), F.col("step_order").alias("dep_order"))
    missing = dep.join(keys.select("plan_id", "dep_key").distinct(), ["plan_id", "dep_key"], "left_anti").select(
        "plan_id", "step_order", "step_key", F.lit("linked_step_missing_dependency").alias("error_code"),
        F.col("dep_key").alias("detail"), F.lit("error").alias("severity"))
    # a known dependency is "future" when no step with that id comes earlier in the list
    first_pos = keys.groupBy("plan_id", "dep_key").agg(F.min("dep_order").alias("first_order"))
    future = dep.join(first_pos, ["plan_id", "dep_key"]).where(F.col("first_order") >= F.col("step_order")).select(
        "plan_id", "step_order", "step_key", F.lit("linked_step_dependency_order_violation").alias("error_code"),
        F.col("dep_key").alias("detail"), F.lit("error").alias("severity"))
    no_deps = s.where((F.col("dependency_type") == "dependent") & (F.size("depends_on") == 0)).select(
        "plan_id", "step_order", "step_key", F.lit("linked_step_dependent_without_depends_on").alias("error_code"),
        F.lit(None).cast("string").alias("detail"), F.lit("error").alias("severity"))
    indep = s.where((F.col("dependency_type") == "independent") & (F.size("depends_on") > 0)).select(
        "plan_id", "step_order", "step_key", F.lit("linked_step_independent_has_depends_on").alias("error_code"),
        F.lit(None).cast("string").alias("detail"), F.lit("warning").alias("severity"))
    out = dup
    for x in (selfdep, missing, future, no_deps, indep):
        out = out.unionByName(x)
    return out.distinct()


def step_availability(steps: DataFrame, status_col: str = "step_status") -> DataFrame:
    """L4: a step is available when it is not cancelled and every dependency
    is accepted (anti join on the dependencies that are not)."""
    accepted = steps.where(F.col(status_col) == "accepted").select("plan_id", F.col("step_key").alias("dep_key")).distinct()
    dep = steps.select("plan_id", "step_order", "step_key", F.explode("depends_on").alias("dep_key"))
    blocked = dep.join(accepted, ["plan_id", "dep_key"], "left_anti").select("plan_id", "step_order").distinct()
    base = steps.select("plan_id", "step_order", "step_key", status_col)
    ok = base.join(blocked, ["plan_id", "step_order"], "left_anti")
    flagged = base.join(ok.select("plan_id", "step_order").withColumn("_ok", F.lit(True)), ["plan_id", "step_order"], "left")
    return flagged.select("plan_id", "step_order", "step_key",
                          (F.coalesce("_ok", F.lit(False)) & (F.col(status_col) != "cancelled")).alias("available"))


def inherit_conditions(steps: DataFrame, closure: DataFrame, cond_col: str = "conditions") -> DataFrame:
    """(plan_id, step_order, step_key, condition) -- a step's own conditions
    plus those of all its ancestors, de-duplicated."""
    own = steps.select("plan_id", "step_order", "step_key", F.explode(cond_col).alias("condition"))
    anc_conds = steps.select("plan_id", F.col("step_key").alias("ancestor_key"), F.explode(cond_col).alias("condition")).distinct()
    me = steps.select("plan_id", "step_order", "step_key")
    inherited = (
        me.join(closure, ["plan_id", "step_key"])
        .join(anc_conds, ["plan_id", "ancestor_key"])
        .select("plan_id", "step_order", "step_key", "condition")
    )
    return own.unionByName(inherited).distinct()


def plan_counts(steps: DataFrame) -> DataFrame:
    """step_count and dependent_step_count per plan."""
    return steps.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.count_if(F.col("dependency_type") == "dependent").alias("dependent_step_count"),
    )


def aggregate_signature(group_by: Column, metrics: Column) -> Column:
    return F.concat_ws("|", F.concat_ws(",", F.array_sort(group_by)), F.concat_ws(",", F.array_sort(metrics)))


def prune_duplicate_aggregates(steps: DataFrame) -> DataFrame:
    """Drop unscoped aggregate steps whose (group-by set, metric set)
    equals that of a scoped aggregate step in the same plan."""
    agg = F.col("intent_type") == "SELECT_AGGREGATE"
    sig = aggregate_signature(F.col("group_by"), F.col("metrics"))
    s = steps.withColumn("_sig", sig)
    scoped = s.where(agg & (F.size("metrics") > 0) & (F.size("conditions") > 0)).select("plan_id", "_sig").distinct()
    drop = s.where(agg & (F.size("conditions") == 0)).join(scoped, ["plan_id", "_sig"], "left_semi").select("plan_id", "step_order")
    return s.join(drop, ["plan_id", "step_order"], "left_anti").drop("_sig")


def infer_dependencies(steps: DataFrame, text_col: str = "plan_text", terms: Sequence[str] = DEPENDENCY_TERMS) -> DataFrame:
    """With sequential wording, a read step without dependencies depends on
    the last mutating step before it (window per plan)."""
    compact = F.regexp_replace(F.lower(F.col(text_col)), r"\s+", "")
    hit = F.lit(False)
    for t in terms:
        hit = hit | compact.contains(t)
    w = Window.partitionBy("plan_id").orderBy("step_order").rowsBetween(Window.unboundedPreceding, -1)
    last_mut = F.last(F.when(F.col("intent_type").isin(*MUTATING), F.col("step_key")), ignorenulls=True).over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy("plan_id"))
    s = steps.withColumn("_last", last_mut).withColumn("_n", n).withColumn("_hit", hit)
    applies = (F.col("_hit") & (F.col("_n") > 1) & F.col("intent_type").isin(*READING)
               & (F.size("depends_on") == 0) & F.col("_last").isNotNull())
    return s.select(
        "plan_id", "step_order", "step_key",
        F.when(applies, F.array("_last")).otherwise(F.col("depends_on")).alias("depends_on"),
        F.when(applies, F.lit("dependent")).otherwise(F.col("dependency_type")).alias("dependency_type"),
    )


def split_mixed_steps(steps: DataFrame) -> DataFrame:
    """A step with metrics and actions (or a derived label) becomes a
    mutating step plus a dependent ``<id>_aggregate`` step."""
    mixed = (F.size("metrics") > 0) & ((F.size("actions") > 0) | F.col("has_derived"))
    mut_intent = F.when(F.col("has_derived"), F.lit("ADD_DERIVED_COLUMN")).otherwise(F.lit("UPDATE_NUMERIC_VALUE"))
    empty = F.array().cast("array<string>")
    part_mut = F.struct(F.col("step_key").alias("k"), mut_intent.alias("intent"), F.col("actions").alias("acts"),
                        empty.alias("mets"), F.col("depends_on").alias("deps"), F.lit("mutate").alias("part"))
    part_agg = F.struct(F.concat("step_key", F.lit("_aggregate")).alias("k"), F.lit("SELECT_AGGREGATE").alias("intent"),
                        empty.alias("acts"), F.col("metrics").alias("mets"), F.array("step_key").alias("deps"),
                        F.lit("aggregate").alias("part"))
    same = F.struct(F.col("step_key").alias("k"), F.col("intent_type").alias("intent"), F.col("actions").alias("acts"),
                    F.col("metrics").alias("mets"), F.col("depends_on").alias("deps"), F.lit("unchanged").alias("part"))
    out = steps.select("plan_id", "step_order", F.explode(F.when(mixed, F.array(part_mut, part_agg)).otherwise(F.array(same))).alias("s"))
    return out.select("plan_id", "step_order", F.col("s.k").alias("step_key"), F.col("s.intent").alias("intent_type"),
                      F.col("s.acts").alias("actions"), F.col("s.mets").alias("metrics"), F.col("s.deps").alias("depends_on"),
                      F.col("s.part").alias("part"))
