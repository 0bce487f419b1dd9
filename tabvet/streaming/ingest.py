"""Structured Streaming jobs (X1, X2; late rows in ``windows``).

* X1: files dropped into a folder -> bronze rows, de-duplicated by content
  hash within a watermark (bounded state), written to a Parquet sink.
* X2: tumbling-window event metrics with a watermark; each micro-batch's
  updated windows are appended to a Parquet table with their batch id, and
  the current value of a window is its latest version (latest wins), so the
  state store only keeps windows newer than the watermark.

Both run with ``trigger(availableNow=True)`` so a test (or a scheduled job)
drains what is there and stops; checkpoints live in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.operators.ingest import bronze


def stream_bronze(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str, checkpoint_dir: str,
                  event_time: str = "ingested_at", delay: str = "30 days", files_per_batch: int | None = None) -> DataFrame:
    """Bronze over a growing folder of row files; duplicates (same payload
    hash) arriving within ``delay`` of the first copy are dropped, also when they
    come in a later micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source_dir)
    b = bronze(rows).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["payload_hash"])
    q = (b.writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def window_metrics(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """A4/A8 per tumbling window and event type (works on batch and stream)."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", size).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value"),
                 F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))
                       .otherwise(F.lit(0).cast("decimal(18,2)"))).alias("purchase_value")))


def stream_window_metrics(spark: SparkSession, source_dir: str, glob: str, schema: T.StructType, table_dir: str,
                          checkpoint_dir: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Streaming windowed metrics in update mode; returns the current table."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)
    # watermarks need a zoned timestamp; Parquet's zone-less values are read as
    # NTZ, so they are pinned to UTC explicitly (independent of the session zone)
    events = events.withColumn("ts", utc_instant(F.col("ts")))
    agg = window_metrics(events, size, delay)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(table_dir)

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_windows(spark.read.parquet(table_dir))


def utc_instant(ntz: Column) -> Column:
    """Zone-less wall time -> the instant of that wall time in UTC."""
    text = F.concat(F.date_format(ntz, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")


def utc_text(instant: Column) -> Column:
    """Instant rendered as UTC wall time, whatever the session zone."""
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def current_windows(versions: DataFrame) -> DataFrame:
    """Latest version of every (window, event type) row."""
    cols = [c for c in versions.columns if c not in ("w", "event_type", "batch_id")]
    latest = versions.groupBy("w", "event_type").agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("v"))
    return latest.select(utc_text(F.col("w.start")).alias("window_start"), "event_type", "v.*")
