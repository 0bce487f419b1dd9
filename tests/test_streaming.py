from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabvet.session import shared_path
from tabvet.streaming import windows as W

DAY = 86_400_000
SCHEMA = "ts timestamp, event_type string, value double, batch_id int"


def run(spark, deliveries, name):
    src, table, ckpt = (shared_path(spark, "stream-test", name, p) for p in ("src", "table", "ckpt"))
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(src)
        W.drain(spark, spark.readStream.schema(SCHEMA).parquet(src), table, ckpt, DAY, "1 hour")
    changes = spark.read.parquet(table)
    report = W.window_report(changes).withColumn("start_ms", F.unix_millis("window_start")).drop("window_start").collect()
    return changes, {(r.start_ms, r.event_type): (r.n_events, r.total_cents, r.purchase_cents, r.closed, r.n_late, r.late_cents) for r in report}


def expected(deliveries):
    """Row by row: a window is closed once the latest time of earlier deliveries, less an hour, has reached its end."""
    out = defaultdict(lambda: [0, 0, 0, None, 0, 0])
    seen = 0
    for rows in deliveries:
        mark = seen - 3_600_000
        for ts, kind, value, _ in rows:
            ms = None if ts is None else int(ts.timestamp() * 1000)
            start = None if ms is None else ms - ms % DAY
            cell, cents = out[start, kind], round((value or 0) * 100)
            if start is None or start + DAY <= mark:
                cell[4] += 1
                cell[5] += cents
            else:
                cell[0] += 1
                cell[1] += cents
                cell[2] += cents if kind == "purchase" else 0
        seen = max([seen, *(int(ts.timestamp() * 1000) for ts, *_ in rows if ts is not None)])
    for (start, _), cell in out.items():
        cell[3] = None if start is None else start + DAY <= seen - 3_600_000
    return {k: tuple(v) for k, v in out.items()}


def test_out_of_order_deliveries_against_rows(spark):
    """Nulls in every column, repeated rows, a column named as one of the table's, windows only late rows know, a hot window."""
    rng = random.Random(3)
    base = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)

    def event(day):
        ts = None if rng.random() < 0.03 else base + dt.timedelta(days=day, milliseconds=rng.randrange(DAY))
        return ts, rng.choice(["purchase", "view", None]), rng.choice([None, 0.0, 1.25, 19.99, -2.5]), 7

    deliveries = [[event(rng.randrange(3)) for _ in range(80)], [event(rng.choice([0, 1, 2, 4, 4, 4])) for _ in range(150)],
                  [event(rng.choice([2, 3, 4, 6])) for _ in range(60)], [event(rng.choice([0, 3, 5, 6])) for _ in range(40)]]
    deliveries[1] += deliveries[1][:10]
    changes, got = run(spark, deliveries, "random")
    assert got == expected(deliveries)
    assert sum(v[4] for v in got.values()) > 30 and any(v[0] == 0 for v in got.values())
    # On-time and late rows add up to all rows, and a window closes once.
    assert sum(v[0] + v[4] for v in got.values()) == sum(map(len, deliveries))
    closed = Counter((r.start_ms, r.event_type) for r in changes.where("kind = 'closed'").collect())
    assert closed and set(closed.values()) == {1}
    # A task sends one row per window and type, however many rows one window holds.
    assert changes.where("kind = 'open'").groupBy("batch_id", "start_ms", "event_type").count().where("count > 1").count() == 0


def test_empty_delivery(spark):
    assert run(spark, [[], [(None, None, None, 1)]], "empty")[1] == {(None, None): (0, 0, 0, None, 1, 0)}
