"""Ingest and sink invariants."""

from __future__ import annotations

import tempfile
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tabvet.queries import q_ingest as QI
from tabvet.session import shared_path
from tabvet.sources import sinks as K
from tabvet.sources.tables import stg_b


def test_gold_rows_equal_parsed_bronze_rows(spark, sf):
    bronze = QI._bronze(spark, sf)
    parsed = bronze.where(F.col("parse_status") == "parsed").count()
    ad, ga = QI._silver(spark, sf)
    gold = QI.gold_report_daily(spark, sf)
    assert ad.count() + ga.count() == parsed == gold.count()
    # every bronze row without a date is kept as bronze_only with a reason
    only = bronze.where(F.col("parse_status") == "bronze_only")
    assert only.where(F.col("reason") != "missing_report_date").count() == 0


def test_incremental_ingest_adds_only_new_hashes(spark, sf):
    new = QI.incremental_new_rows(spark, sf)
    bronze = QI._bronze(spark, sf)
    existing = {r[0] for r in bronze.where(F.col("row_id") % 3 == 0).select("payload_hash").collect()}
    assert all(r["payload_hash"] not in existing for r in new.collect())


def test_snapshot_refuses_existing_and_replaces_on_request(spark, sf):
    path = tempfile.mkdtemp(prefix="tabvet-stg-") + "/SA"
    df = stg_b(spark, sf)
    K.write_staging_snapshot(df, path)
    with pytest.raises(AnalysisException):
        K.write_staging_snapshot(df, path)
    K.write_staging_snapshot(df.where("row_id < 10"), path, replace=True)
    assert spark.read.parquet(path).count() == df.where("row_id < 10").count()


def test_batch_log_records_failure(spark, sf):
    base = tempfile.mkdtemp(prefix="tabvet-log-")
    df = stg_b(spark, sf)
    K.write_with_batch_log(df, f"{base}/data", f"{base}/log", "b1")
    with pytest.raises(AnalysisException):  # target exists: logged as failed, then raised
        K.write_with_batch_log(df, f"{base}/data", f"{base}/log", "b2")
    log = spark.read.parquet(f"{base}/log")
    got = {r["batch_id"]: (r["status"], r["message"] is not None) for r in log.collect()}
    assert got == {"b1": ("success", False), "b2": ("failed", True)}


def test_dimensions_hold_every_key_of_the_facts_once(spark, sf):
    from tabvet.operators import ingest as IG

    ad, ga = (x.cache() for x in QI._silver(spark, sf))
    members = IG.dimension_members(ad, ga).collect()
    held = {(r.kind, r.member_key) for r in members}
    assert len(held) == len(members) and {r.kind for r in members} == set(IG.DIMENSIONS)
    assert ("date", IG.UNKNOWN_DATE) in held
    for facts, kinds in ((ad, ("media", "date", "campaign", "ad_group", "creative", "device")),
                         (ga, ("media", "date", "campaign", "creative", "device", "event"))):
        for kind in kinds:
            keys = {r[0] for r in facts.select(f"{kind}_key").distinct().collect()} - {None}
            assert keys and {(kind, k) for k in keys} <= held
    # a member may have a name, a code or both; a campaign without a name is listed under its code
    groups = [r for r in members if r.kind == "ad_group"]
    assert {(r.name is None, r.code is None) for r in groups} == {(False, False), (False, True), (True, False)}
    assert all(r.name is not None for r in members if r.kind == "campaign")
    assert {r.name for r in members if r.is_conversion} == {"purchase", "회원 가입완료", "Form_Complete"}


def test_late_members_are_added_and_known_ones_stay(spark):
    from tabvet.operators import ingest as IG

    schema = "kind string, member_key string, source_name string, name string, code string, category string, is_conversion boolean"
    known = spark.createDataFrame([("device", "k1", None, "PC", None, "kept as it is", None)], schema)
    found = spark.createDataFrame([("device", "k1", None, "PC", None, "PC", None), ("event", "k1", None, "e", None, "e", False)], schema)
    assert sorted((r.kind, r.category) for r in IG.dim_merge(found, known).collect()) == [("device", "kept as it is"), ("event", "e")]


def test_files_of_a_snapshot_do_not_grow_with_the_tasks(spark):
    """A channel with half of the rows, nine small ones and a NULL one, from 40 tasks: ranges of rows, not tasks x channels files."""
    df = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 9))
        .alias("source_channel"), F.sha2(F.col("id").cast("string"), 256).alias("cost")).repartition(40)
    path = shared_path(spark, "sink-test", uuid.uuid4().hex)
    K.write_staging_snapshot(df, path, rows_per_file=2_000)
    back = spark.read.parquet(path)
    assert sorted(back.select(*df.columns).collect(), key=str) == sorted(df.collect(), key=str)
    files = back.groupBy("source_channel", F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high")).collect()
    channels = {f.source_channel for f in files}
    assert len(files) <= 10 + len(channels) and max(f.n for f in files) < 4_000
    hot = sorted((f.low, f.high) for f in files if f.source_channel == "hot")
    assert len(hot) > 3 and all(a[1] < b[0] for a, b in zip(hot, hot[1:]))
    empty = shared_path(spark, "sink-test", uuid.uuid4().hex)
    K.write_staging_snapshot(df.where("row_id < 0"), empty)
    assert spark.read.schema(df.schema).parquet(empty).count() == 0
