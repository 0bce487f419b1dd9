"""Queries for the streaming jobs (X1, X2); results must equal the batch ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabvet.queries.q_ingest import BASE_SQL
from tabvet.queries.registry import register
from tabvet.session import shared_path
from tabvet.sources.derived import import_rows
from tabvet.sources.tables import load
from tabvet.streaming import ingest as X
from tabvet.streaming import windows as W


@register(
    "stream_ingest_bronze",
    BASE_SQL + "SELECT DISTINCT payload_hash, report_date, parse_status, reason FROM bronze2",
)
def stream_ingest_bronze(spark, sf):
    run = uuid.uuid4().hex
    src, sink, ckpt = (shared_path(spark, "stream", run, p) for p in ("src", "sink", "ckpt"))
    rows = import_rows(spark, sf)
    base = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    # three file drops, then a re-delivery of some rows a day later (duplicates)
    for d in range(3):
        drop = rows.where(F.col("row_id") % 3 == d).withColumn("ingested_at", base + F.expr(f"INTERVAL {d} HOURS"))
        drop.write.mode("append").parquet(src)
    again = rows.where(F.col("row_id") % 7 == 0).withColumn("ingested_at", base + F.expr("INTERVAL 1 DAY"))
    again.write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    files = spark.read.parquet(src).select(F.input_file_name()).distinct().count()
    out = X.stream_bronze(spark, src, schema, sink, ckpt, files_per_batch=-(-files // 4) or 1)  # four micro-batches
    return out.select("payload_hash", "report_date", "parse_status", "reason")


@register(
    "stream_metric_by_window",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_events,
  round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) AS total_value,
  round(CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE), 6) AS purchase_value
FROM events GROUP BY 1, 2""",
)
def stream_metric_by_window(spark, sf):
    run = uuid.uuid4().hex
    table, ckpt = (shared_path(spark, "stream", run, p) for p in ("table", "ckpt"))
    schema = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").schema
    cur = X.stream_window_metrics(spark, sf, "events.parquet", schema, table, ckpt)
    return cur.select("window_start", "event_type", "n_events",
                      F.round(F.col("total_value").cast("double"), 6).alias("total_value"),
                      F.round(F.col("purchase_value").cast("double"), 6).alias("purchase_value"))


@register(
    "stream_late_rows",
    """WITH d AS (SELECT ts, event_type, CAST(value AS DECIMAL(18,2)) AS v, date_trunc('day', ts) AS day,
  coalesce(CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END, 0) + (event_id % 11 = 0)::INTEGER AS delivery FROM events),
marks AS (SELECT k.delivery, (SELECT max(ts) - INTERVAL 2 DAY FROM d WHERE d.delivery < k.delivery) AS mark
          FROM (SELECT DISTINCT delivery FROM d) k),
r AS (SELECT d.*, d.day IS NULL OR coalesce(d.day + INTERVAL 1 DAY <= marks.mark, false) AS late FROM d JOIN marks USING (delivery))
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) FILTER (NOT late) AS n_events,
  round(CAST(coalesce(sum(v) FILTER (NOT late), 0) AS DOUBLE), 6) AS total_value,
  round(CAST(coalesce(sum(v) FILTER (NOT late AND event_type = 'purchase'), 0) AS DOUBLE), 6) AS purchase_value,
  day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM d) AS closed, count(*) FILTER (late) AS n_late,
  round(CAST(coalesce(sum(v) FILTER (late), 0) AS DOUBLE), 6) AS late_value
FROM r GROUP BY day, event_type""",
)
def stream_late_rows(spark, sf):
    """Three ten-day deliveries; every eleventh event comes one delivery later, behind the watermark for most."""
    run = uuid.uuid4().hex
    src, table, ckpt = (shared_path(spark, "stream", run, p) for p in ("src", "table", "ckpt"))
    events = load(spark, sf, "events")
    day = F.dayofmonth("ts")
    delivery = F.coalesce(F.when(day <= 10, 0).when(day <= 20, 1).when(day > 20, 2), F.lit(0)) + (F.col("event_id") % 11 == 0).cast("int")
    rows = events.select(X.utc_instant(F.col("ts").cast("timestamp_ntz")).alias("ts"), "event_type", "value", delivery.alias("delivery"))
    schema = rows.drop("delivery").schema
    for d in range(4):
        rows.where(F.col("delivery") == d).drop("delivery").write.mode("append").parquet(src)
        W.drain(spark, spark.readStream.schema(schema).parquet(src), table, ckpt, 86_400_000, "2 days")

    def amount(c: str):
        return F.round((F.col(c).cast("decimal(20,0)") / 100).cast("double"), 6)

    return W.window_report(spark.read.parquet(table)).select(
        X.utc_text(F.col("window_start")).alias("window_start"), "event_type", "n_events", amount("total_cents").alias("total_value"),
        amount("purchase_cents").alias("purchase_value"), "closed", "n_late", amount("late_cents").alias("late_value"))
