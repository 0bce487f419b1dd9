"""Invariants of the overlay and the gated mutation (SURVEY section 5 (c))."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabvet.operators import mutation as MU
from tabvet.operators import publish as PB
from tabvet.operators import overlay as OV

RAW = [(1, "10", "a"), (2, "20", "b"), (3, "30", "c"), (4, None, "d")]
AS_OF = dt.datetime(2024, 6, 1)


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(RAW, "row_id long, cost string, tag string")


def deltas(spark, rows):
    schema = ("delta_item_id long, linked_plan_id string, step_key string, step_order int, source_row_id long, "
              "after map<string,string>, delta_status string, expires_at timestamp_ntz")
    return spark.createDataFrame(rows, schema)


def test_empty_overlay_equals_raw(spark, raw):
    empty = deltas(spark, [])
    ov = OV.overlay_map(OV.latest_delta(empty))
    out = OV.apply_overlay(OV.join_overlay(raw, ov), ["cost", "tag"])
    assert sorted(out.collect()) == sorted(raw.collect())


def test_latest_wins_presence_null_and_twice_is_once(spark, raw):
    later = AS_OF + dt.timedelta(hours=1)
    d = deltas(spark, [
        (11, "p", "s1", 1, 1, {"cost": "0"}, "approved", later),
        (12, "p", "s2", 2, 1, {"cost": "5"}, "approved", later),   # later step wins
        (21, "p", "s1", 1, 2, {"cost": None}, "approved", later),  # overlay to NULL counts
        (31, "p", "s1", 1, 3, {"cost": "99"}, "pending", later),   # not approved
        (41, "p", "s1", 1, 4, {"cost": "7"}, "approved", AS_OF - dt.timedelta(hours=1)),  # expired
    ])
    closure = spark.createDataFrame([("p", "s3", "s1"), ("p", "s3", "s2")], "plan_id string, step_key string, ancestor_key string")
    app = OV.ancestor_deltas(d.withColumn("target_table", F.lit("T")), closure, "p", "s3", 3, AS_OF, "T")
    ov = OV.overlay_map(OV.latest_delta(app))
    once = OV.apply_overlay(OV.join_overlay(raw, ov), ["cost"])
    got = {r["row_id"]: r["cost"] for r in once.collect()}
    assert got == {1: "5", 2: None, 3: "30", 4: None}
    twice = OV.apply_overlay(OV.join_overlay(once, ov), ["cost"])
    assert sorted(twice.collect()) == sorted(once.collect())


def test_predicate_modes_differ(spark, raw):
    later = AS_OF + dt.timedelta(hours=1)
    d = deltas(spark, [(11, "p", "s1", 1, 3, {"cost": "0"}, "approved", later)])
    ov = OV.overlay_map(OV.latest_delta(d))
    from tabvet.functions.semantics import num

    agg = OV.overlay_aggregate(raw, ov, ["cost"], num("cost") > 25, [], [F.count(F.lit(1)).alias("n")])
    assert agg.first()["n"] == 1  # raw predicate keeps row 3 although its effective cost is 0
    det = OV.overlay_detail(raw, ov, ["cost"], num("cost") > 25)
    assert det.count() == 0  # effective predicate drops it


def test_rollback_of_update_is_identity_and_backup_covers(spark, raw):
    where = F.col("row_id") <= 2
    backups = MU.backup_rows(raw, where, "scope", "SA")
    cov = MU.backup_coverage(raw.where(where), backups, "scope", "SA").first()
    assert cov["complete"] and cov["affected_ids"] == 2
    after = MU.apply_update(raw, where, [{"target_field": "cost", "operation": "set_zero"},
                                         {"target_field": "tag", "operation": "set_literal", "value": None}])
    assert {r["row_id"]: r["cost"] for r in after.collect()} == {1: "0", 2: "0", 3: "30", 4: None}
    restored = MU.rollback(after, backups, ["cost", "tag"]).select(*raw.columns)
    assert sorted(restored.collect()) == sorted(raw.collect())
    # insert-if-absent: a second backup of the same scope adds nothing
    assert MU.backup_rows(raw, where, "scope", "SA", existing=backups).count() == 0


def test_guards(spark, raw):
    with pytest.raises(MU.GateError):
        MU.require_predicate([{"conditions": []}])
    with pytest.raises(MU.GateError):
        MU.apply_update(raw, F.lit(True), [{"target_field": "row_id", "operation": "set_zero"}], protected=["row_id"])
    cands = spark.createDataFrame([("SA", "비용"), ("SA", "캠페인 ID"), ("SA", "source_channel"), ("SA", "노출수")],
                                  "target_table string, column_name string")
    pol = spark.createDataFrame([("SA", "노출수", True)], "target_table string, column_name string, active boolean")
    assert [r[1] for r in MU.writable_targets(cands, pol).collect()] == ["비용"]


GROUPS = [{"conditions": [{"field": "row_id", "operator": "lte", "values": ["2"]}]}]
ZERO = [{"target_field": "cost", "operation": "set_zero"}]


@pytest.fixture
def table(spark, raw):
    t = PB.Snapshots(spark, tempfile.mkdtemp(prefix="tabvet-snap-"))
    assert t.publish(raw, None, {"operation": "load"}) == 0
    return t


def _costs(t, version=None):
    return {r["row_id"]: r["cost"] for r in t.read(version).collect()}


def _update(t, approval=None, groups=GROUPS, where=None, actions=ZERO, scope="s", **changes):
    approval = approval or {"approved": True, **PB.preview(t, groups, actions), **changes}
    return PB.gated_update(t, groups, F.col("row_id") <= 2 if where is None else where, actions, approval, scope, "SA", protected=["row_id"])


def test_gated_update_and_rollback(table):
    before = _costs(table)
    assert _update(table) == 1
    assert _costs(table) == {**before, 1: "0", 2: "0"} and _costs(table, 0) == before
    assert _update(table, scope="t", where=F.col("row_id") == 3) == 2
    assert PB.gated_rollback(table, "s", "SA", ["cost"]) == 3
    assert _costs(table) == {**before, 3: "0"}
    assert table.current()["parent"] == 2


@pytest.mark.parametrize("change", [{"approved": False}, {"sql_fingerprint": "x"}, {"preview_fingerprint": "x"}, {"parent": 7}])
def test_without_its_approval_nothing_is_published(table, change):
    with pytest.raises(MU.GateError):
        _update(table, **change)
    assert table.version() == 0 and table.backups() is None


def test_approval_of_an_earlier_version_is_stale(table):
    approval = {"approved": True, **PB.preview(table, GROUPS, ZERO)}
    _update(table)
    with pytest.raises(MU.GateError, match="stale_parent"):
        _update(table, approval=approval)
    with pytest.raises(MU.GateError, match="stale_parent"):
        table.publish(table.read(), 0, {})
    assert table.version() == 1


def test_two_writers_on_one_parent(spark, table, monkeypatch):
    """The second one has looked before the first one's entry was there; the file system refuses its entry."""
    late = PB.Snapshots(spark, table.root)
    seen = late._entries()
    assert table.publish(table.read(), 0, {}) == 1
    monkeypatch.setattr(late, "_entries", lambda: seen)
    with pytest.raises(MU.GateError, match="stale_parent"):
        late.publish(table.read(0), 0, {})
    assert table.version() == 1


def test_predicates_and_targets_are_checked(table):
    for groups in ([{"conditions": []}], [], [{"conditions": [{"field": "1 = 1"}]}],
                   [{"conditions": [{"field": "1", "operator": "eq", "values": ["1"]}, *GROUPS[0]["conditions"]]}]):
        with pytest.raises(MU.GateError, match="predicate"):
            _update(table, groups=groups)
    with pytest.raises(MU.GateError, match="protected"):
        _update(table, actions=[{"target_field": "row_id", "operation": "set_zero"}])
    assert table.version() == 0


def test_missing_ids_and_missing_backups(spark, table, monkeypatch):
    table.publish(table.read().unionByName(spark.createDataFrame([(None, "5", "x")], table.read().schema)), 0, {})
    with pytest.raises(MU.GateError, match="requires_row_id"):
        _update(table, where=F.col("cost") == "5")
    kept = MU.backup_rows
    monkeypatch.setattr(MU, "backup_rows", lambda *a, **b: kept(*a, **b).where("source_row_id <> 2"))
    with pytest.raises(MU.GateError, match="backup_incomplete"):
        _update(table)
    assert table.version() == 1
    monkeypatch.setattr(MU, "backup_rows", kept)
    assert _update(table) == 2  # the second attempt adds what the first one lacked


def test_crash_before_the_entry_publishes_nothing(table, monkeypatch):
    before = _costs(table)
    with monkeypatch.context() as m:
        m.setattr(json, "dumps", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("crash")) if "data" in a[0] else "x")
        with pytest.raises(RuntimeError, match="crash"):
            table.publish(table.read().where("row_id > 1"), 0, {})
    assert table.version() == 0 and _costs(table) == before
    with open(os.path.join(table.root, "manifest", f"{5:012d}.json"), "w") as f:
        f.write('{"version": 5, "par')  # begun, never finished
    assert table.version() == 0 and table.publish(table.read(), 0, {}) == 6 and _costs(table) == before


def test_upsert_keeps_unlisted_columns(spark):
    e = spark.createDataFrame([(1, "old", 1.0), (2, "keep", 2.0)], "k long, name string, v double")
    i = spark.createDataFrame([(1, "new", 10.0), (3, "ins", 30.0)], "k long, name string, v double")
    out = {r["k"]: (r["name"], r["v"]) for r in MU.upsert_by_key(e, i, ["k"], ["v"]).collect()}
    assert out == {1: ("old", 10.0), 2: ("keep", 2.0), 3: ("ins", 30.0)}
