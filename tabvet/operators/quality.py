"""Quality and evaluation reports (Q1-Q9, W7) as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions.semantics import parse_number


def is_empty(v: Column) -> Column:
    return F.trim(F.coalesce(v.cast("string"), F.lit(""))) == ""


def satisfies(v: Column, operator: str) -> Column:
    """Q1 row condition: gt_zero / zero_or_empty / empty / not_empty."""
    if operator == "gt_zero":
        n = parse_number(v.cast("string"))
        return n.isNotNull() & (n > 0)
    if operator == "zero_or_empty":
        return is_empty(v) | F.coalesce(parse_number(v.cast("string")) == 0, F.lit(False))
    if operator == "empty":
        return is_empty(v)
    if operator == "not_empty":
        return ~is_empty(v)
    return F.lit(True)


def check_row_conditions(rows: DataFrame, checks: Sequence[tuple[str, str]]) -> DataFrame:
    """Q1: per (column, operator): rows checked and rows violating the condition
    (one aggregate pass for all checks)."""
    aggs = []
    for i, (c, op) in enumerate(checks):
        aggs += [F.count(F.lit(1)).alias(f"n{i}"), F.count_if(~satisfies(F.col(c), op)).alias(f"v{i}")]
    one = rows.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(op).alias("operator"), F.col(f"n{i}").alias("checked_rows"),
                 F.col(f"v{i}").alias("violations")) for i, (c, op) in enumerate(checks)]))
    return one.select(stacked.alias("s")).select("s.*")


def check_update_after(delta_long: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """Q2: per delta item -- changed columns cover every expected target and
    every target's after-value is numerically 0."""
    t = F.array(*[F.lit(x) for x in targets])
    g = delta_long.groupBy(key).agg(
        F.collect_set("column_name").alias("_cols"),
        F.bool_and(F.when(F.array_contains(t, F.col("column_name")),
                          F.coalesce(parse_number(F.col("new_value")) == 0, F.lit(False)))).alias("_zero"))
    covers = F.size(F.array_except(t, F.col("_cols"))) == 0
    zero = F.coalesce(F.col("_zero"), F.lit(False))
    return g.select(key, covers.alias("covers_targets"), zero.alias("after_zero"), (covers & zero).alias("passed"))


def result_status(s: DataFrame) -> Column:
    """Q3: PASS / CHECK / ERROR from errors, validation and preview state; a
    passing result without preview rows stays PASS only for a valid zero-row preview."""
    base = (F.when(F.col("error_count") > 0, F.lit("CHECK"))
            .when((F.col("validation_status") == "passed") & (F.col("preview_status") == "pending_user_confirmation"), F.lit("PASS"))
            .otherwise(F.lit("ERROR")))
    base = F.when(~F.col("has_sql"), F.lit("CHECK")).otherwise(base)
    zero_ok = ((F.col("validation_status") == "passed") & (F.col("preview_status") == "pending_user_confirmation")
               & (F.col("affected_row_count") == 0) & (F.col("previewed_row_count") == 0))
    base = F.when((base == "PASS") & (F.col("previewed_row_count") <= 0) & ~zero_ok, F.lit("CHECK")).otherwise(base)
    return F.when((base == "PASS") & (F.col("semantic_error_count") > 0), F.lit("CHECK")).otherwise(base)


def pct(num: Column, den: Column) -> Column:
    """Exact percentage at 6 decimals (decimal division, rounded half-up once)."""
    rate = num.cast("decimal(38,0)") * 100 / den.cast("decimal(38,0)")
    return F.when(den > 0, rate).otherwise(F.lit(0).cast("decimal(38,6)"))


def suite_metrics(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q4: total, pass count/rate and semantic pass/fail/pending per suite run."""
    sem = F.col("semantic_status")
    g = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "PASS").alias("pass_count"),
        F.count_if(sem == "passed").alias("semantic_pass_count"),
        F.count_if(sem == "failed").alias("semantic_fail_count"),
        F.count_if(sem.isin(*FV.SEMANTIC_PENDING_STATUSES) | sem.rlike(FV.REVIEW_REQUIRED_PATTERN)).alias("semantic_pending_count"),
    )
    return g.withColumns({"pass_rate": pct(F.col("pass_count"), F.col("total")),
                          "semantic_pass_rate": pct(F.col("semantic_pass_count"), F.col("total"))})


def model_suite_summary(metrics: DataFrame) -> DataFrame:
    """Q5: mean of per-run rates by (model, suite)."""
    return metrics.groupBy("model", "suite").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("pass_rate"), 6).cast("double").alias("pass_rate"),
        F.round(F.avg("semantic_pass_rate"), 6).cast("double").alias("semantic_pass_rate"))


def review_completeness(metrics: DataFrame) -> DataFrame:
    """Q7: runs with pending reviews or fewer reviewed than total."""
    reviewed = F.col("semantic_pass_count") + F.col("semantic_fail_count")
    return metrics.where((F.col("semantic_pending_count") > 0) | (reviewed != F.col("total"))).select(
        "model", "suite", "run", "semantic_pending_count", reviewed.alias("reviewed_count"), "total")


def pass_streaks(metrics: DataFrame, threshold: float = FV.CYCLE_PASS_THRESHOLD,
                 required: int = FV.CYCLE_REQUIRED_STREAK) -> DataFrame:
    """Per model and cycle, mean pass rate over the paired suites, whether it
    is strictly above the threshold, and the running streak (gaps and islands)."""
    cyc = metrics.groupBy("model", "run").agg(F.round(F.avg("pass_rate"), 6).alias("pass_average"))
    passed = F.col("pass_average") > threshold
    w = Window.partitionBy("model").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    c = cyc.withColumn("passed", passed).withColumn("_grp", F.sum(F.when(passed, 0).otherwise(1)).over(w))
    w2 = Window.partitionBy("model", "_grp").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("streak", F.sum(F.when(F.col("passed"), 1).otherwise(0)).over(w2).cast("long"))
    return c.withColumn("reached", F.col("streak") >= required).withColumn(
        "pass_average", F.col("pass_average").cast("double")).drop("_grp")


def layer_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Q8: row count of every table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def multistep_rollup(step_results: DataFrame, errors: DataFrame) -> DataFrame:
    """Q9: a plan passes only if all its steps pass; summed counts; sorted errors."""
    g = step_results.groupBy("plan_id").agg(
        F.bool_and(F.col("status") == "PASS").alias("passed"), F.count(F.lit(1)).alias("step_count"),
        F.sum("affected_row_count").cast("long").alias("affected_row_count"))
    e = errors.groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_list("error_code")), ",").alias("errors"))
    return g.join(e, "plan_id", "left")


def parse_report_lines(lines: DataFrame, keys: Sequence[str] = ("model", "suite", "run")) -> DataFrame:
    """Q6: per report (``keys``) the case rows of the pipe table and their
    PASS count, the top-level semantic review lines, and the step headers with
    their step semantic lines."""
    v = F.col("value")
    row = v.rlike(FV.REPORT_ROW_PATTERN)
    return lines.groupBy(*keys).agg(
        F.count_if(row).alias("total"),
        F.count_if(row & (F.regexp_extract(v, FV.REPORT_ROW_PATTERN, 2) == "PASS")).alias("pass_count"),
        F.count_if(v.rlike(FV.SEMANTIC_PASSED_PATTERN)).alias("semantic_pass_count"),
        F.count_if(v.rlike(FV.SEMANTIC_FAILED_PATTERN)).alias("semantic_fail_count"),
        F.count_if(v.rlike(FV.SEMANTIC_PENDING_PATTERN)).alias("semantic_pending_count"),
        F.count_if(v.rlike(FV.STEP_HEADER_PATTERN)).alias("step_count"),
        F.count_if(v.rlike(FV.STEP_SEMANTIC_PENDING_PATTERN)).alias("step_semantic_pending_count"),
        F.count_if(v.rlike(FV.STEP_SEMANTIC_REVIEWED_PATTERN)).alias("step_semantic_reviewed_count"),
    )
