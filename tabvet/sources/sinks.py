"""Sinks: staging snapshots, batch / execution / refresh logs, audit lines
(K1-K4, C3). Logs are append-only Parquet (or JSON lines) tables; every
statistic is computed by an aggregate or ``observe`` on the executors."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXECUTION_LOG_SCHEMA = T.StructType([
    T.StructField("request_text", T.StringType()),
    T.StructField("ir_json", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("params_json", T.StringType()),
    T.StructField("sql_fingerprint", T.StringType()),
    T.StructField("affected_row_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("rollback_json", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
BATCH_LOG_SCHEMA = "batch_id string, status string, stats_json string, message string"
REFRESH_LOG_SCHEMA = "refresh_id string, status string, row_count long, error_message string"


def write_staging_snapshot(df: DataFrame, path: str, replace: bool = False, partition_by: str = "source_channel",
                           sort_by: str | None = "row_id", rows_per_file: int = 2_000_000) -> None:
    """K1: replace (overwrite) or refuse when the snapshot exists; partitioned by
    channel, rows sorted within files so row-group statistics prune by id.

    Rows are cut into ranges of (channel, id) of about ``rows_per_file`` counted rows:
    a hot channel is split over several tasks, small ones share a task, and the files
    are at most ranges + channels, whatever the number of tasks before. Rows of one
    id are told apart by their hash; rows equal in every column stay together."""
    order = [partition_by, *([sort_by] if sort_by and sort_by in df.columns else [])]
    ranges = max(1, math.ceil(df.count() / rows_per_file))
    hashable = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out = df.repartitionByRange(ranges, *order, F.xxhash64(*hashable)).sortWithinPartitions(*order)
    out.write.mode("overwrite" if replace else "errorifexists").partitionBy(partition_by).parquet(path)


def write_with_batch_log(df: DataFrame, path: str, log_path: str, batch_id: str, key: str = "source_channel") -> DataFrame:
    """K2: write a batch and append its log row: 'success' with its statistics, or
    'failed' with the whole error, which is raised again after it is logged."""
    spark = df.sparkSession
    obs = Observation(f"batch_{batch_id}")
    try:
        df.observe(obs, F.count(F.lit(1)).alias("row_count")).write.mode("errorifexists").parquet(path)
        # observed metrics allow no DISTINCT: the keys are counted on the written column alone
        keys = spark.read.schema(df.schema).parquet(path).select(F.count_distinct(key)).first()[0]
        stats = {"channels": int(keys), "row_count": int(obs.get["row_count"])}
    except Exception as exc:
        spark.createDataFrame([(batch_id, "failed", None, str(exc))], BATCH_LOG_SCHEMA).write.mode("append").parquet(log_path)
        raise
    spark.createDataFrame([(batch_id, "success", json.dumps(stats, sort_keys=True), None)], BATCH_LOG_SCHEMA).write.mode(
        "append").parquet(log_path)
    return spark.read.parquet(log_path)


def append_audit_jsonl(records: DataFrame, path: str) -> None:
    """K3: one JSON object per record, appended as text lines."""
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "append").text(path)


def write_execution_log(records: DataFrame, path: str) -> None:
    """K4: append execution records with the fixed log schema."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in records.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in EXECUTION_LOG_SCHEMA.fields]
    records.select(*cols).write.mode("append").parquet(path)


def catalog_refresh_log(spark: SparkSession, catalog: DataFrame, catalog_path: str, log_path: str, refresh_id: str) -> DataFrame:
    """Write the catalog, then append 'completed' with its row count, or
    'failed' with the whole error, which is raised again after it is logged."""
    try:
        obs = Observation(f"refresh_{refresh_id}")
        catalog.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(catalog_path)
    except Exception as exc:
        spark.createDataFrame([(refresh_id, "failed", 0, str(exc))], REFRESH_LOG_SCHEMA).write.mode("append").parquet(log_path)
        raise
    spark.createDataFrame([(refresh_id, "completed", int(obs.get["n"]), None)], REFRESH_LOG_SCHEMA).write.mode("append").parquet(log_path)
    return spark.read.parquet(log_path)


def as_json(value: Mapping) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
