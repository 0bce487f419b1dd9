"""Windowed event metrics that close, with late rows counted.

Windows are tumbling. A window closes once the watermark (latest event time of
the micro-batches before, less the delay) has reached its end; its values are then
final and its state is removed. Rows of a window that is closed when they arrive
are late: they change no value and are counted per window instead, so on-time and
late rows add up to all rows.

Each task first sums its rows per window and type (one row per Arrow batch at
most), so a window that holds a third of all rows sends few rows through the
shuffle. The state (RocksDB, kept in the checkpoint folder) holds three numbers per
open window and type, and a timer at its end. A micro-batch writes its rows into a
folder of its own, which a repeated micro-batch replaces.

Defined results: rows without a time stand in no window and are counted as late
under a NULL window; a NULL type is a type of its own; a NULL value counts as a row
and adds nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Start (milliseconds) that stands for rows without a time.
NO_TIME = -(1 << 62)
SUMS = ("n", "cents", "purchase_cents")
PARTS = "start_ms long, event_type string, n long, cents long, purchase_cents long"
CHANGES = f"{PARTS}, kind string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _sum_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        sums = rows.groupby(["start_ms", "event_type"], dropna=False, as_index=False)[list(SUMS)].sum()
        sums["event_type"] = sums["event_type"].astype(object).where(sums["event_type"].notna(), None)
        yield sums


class WindowTotals(StatefulProcessor):
    """Totals of one window and type until it closes. Emits ``open`` (value so far), ``closed`` (final) and ``late`` (rows of this micro-batch)."""

    def __init__(self, size_ms: int):
        self.size_ms = size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, cents long, purchase_cents long")

    def _row(self, key, totals, kind: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, *(int(t) for t in totals), kind)], columns=["start_ms", "event_type", *SUMS, "kind"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added = [0, 0, 0]
        for part in rows:
            added = [a + int(part[c].sum()) for a, c in zip(added, SUMS)]
        end = key[0] + self.size_ms
        if key[0] == NO_TIME or end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, added, "late")
            return
        if self.totals.exists():
            added = [a + b for a, b in zip(added, self.totals.get())]
        else:
            self.handle.registerTimer(end)
        self.totals.update(tuple(added))
        yield self._row(key, added, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            final = self.totals.get()
            self.totals.clear()
            yield self._row(key, final, "closed")

    def close(self) -> None:
        pass


def window_changes(events: DataFrame, size_ms: int, delay: str) -> DataFrame:
    """Changes of the windows of a stream (ts timestamp, event_type, value): one row per micro-batch, window and type."""
    cents = F.coalesce((F.col("value").cast("decimal(18,2)") * 100).cast("long"), F.lit(0).cast("long"))
    start = F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(size_ms))
    rows = events.withWatermark("ts", delay).select(
        F.coalesce(start, F.lit(NO_TIME)).cast("long").alias("start_ms"), F.col("event_type").cast("string").alias("event_type"),
        F.lit(1).cast("long").alias("n"), cents.alias("cents"),
        F.when(F.col("event_type") == "purchase", cents).otherwise(F.lit(0).cast("long")).alias("purchase_cents"))
    # The result has no event-time column, so rows behind the watermark reach the processor instead of being dropped.
    return rows.mapInPandas(_sum_parts, PARTS).groupBy("start_ms", "event_type").transformWithStateInPandas(
        statefulProcessor=WindowTotals(size_ms), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def drain(spark: SparkSession, events: DataFrame, table_dir: str, checkpoint_dir: str, size_ms: int, delay: str) -> None:
    """Process what the stream ``events`` holds and stop; the next call goes on from the checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/batch_id={batch_id}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (window_changes(events, size_ms, delay).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def window_report(changes: DataFrame) -> DataFrame:
    """Per window and type: the on-time totals, whether they are final, and the late rows with their value."""
    late = F.col("kind") == "late"
    latest = F.max_by(F.struct(*SUMS, (F.col("kind") == "closed").alias("closed")),
                      F.when(~late, F.struct("batch_id", (F.col("kind") == "closed").alias("c"))))
    out = changes.groupBy("start_ms", "event_type").agg(
        latest.alias("v"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("n_late"),
        F.sum(F.when(late, F.col("cents")).otherwise(0)).alias("late_cents"))
    return out.select(
        F.when(F.col("start_ms") != NO_TIME, F.timestamp_millis("start_ms")).alias("window_start"), "event_type",
        F.coalesce("v.n", F.lit(0)).cast("long").alias("n_events"), F.coalesce("v.cents", F.lit(0)).cast("long").alias("total_cents"),
        F.coalesce("v.purchase_cents", F.lit(0)).cast("long").alias("purchase_cents"),
        # A window of which only late rows are known has been closed by the watermark; rows without a time have no window.
        F.when(F.col("start_ms") != NO_TIME, F.coalesce("v.closed", F.lit(True))).alias("closed"), "n_late", "late_cents")
