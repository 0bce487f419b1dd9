"""Gated publishing of updates (M1, M3, M4, M7, M9 in one path).

A table is a folder: ``data/`` holds one folder per snapshot, ``backups/`` the
rows as they were before each update, ``manifest/`` one small file per version.
A version exists once its manifest entry does.  Entries are only ever added: the
entry of a version is created by the file system if it is not there yet, so of
two writers on one parent one is refused, and a job that dies earlier leaves
folders that no entry names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.operators import mutation as MU
from tabvet.operators.mutation import GateError


class Snapshots:
    """The published versions of one table in a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _entries(self) -> dict[int, dict | None]:
        """Manifest entries by version; None for one that was begun and never finished."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return {}
        out: dict[int, dict | None] = {}
        for status in self._fs.listStatus(folder):
            name = status.getPath().getName()
            if not name.endswith(".json"):
                continue
            stream = self._fs.open(status.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8")
            finally:
                stream.close()
            try:
                out[int(name.removesuffix(".json"))] = json.loads(text)
            except ValueError:
                out[int(name.removesuffix(".json"))] = None
        return out

    def current(self) -> dict | None:
        """The manifest entry of the latest version."""
        done = {v: e for v, e in self._entries().items() if e}
        return done[max(done)] if done else None

    def version(self) -> int | None:
        entry = self.current()
        return entry["version"] if entry else None

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.current() if version is None else self._entries().get(version)
        if not entry:
            raise GateError("no_published_version")
        return self.spark.read.parquet(f"{self.root}/{entry['data']}")

    def backups(self) -> DataFrame | None:
        folder = self._path(f"{self.root}/backups")
        return self.spark.read.parquet(f"{self.root}/backups") if self._fs.exists(folder) else None

    def publish(self, df: DataFrame, parent: int | None, note: Mapping) -> int:
        """Write a snapshot and make it the version after ``parent``; refused if ``parent`` is not the latest one."""
        if self.version() != parent:
            raise GateError("stale_parent")
        data = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{data}")
        taken = self._entries()  # versions that were begun and not finished stay unused
        if self.version() != parent:
            raise GateError("stale_parent")
        version = max(taken, default=-1) + 1
        entry = {"version": version, "parent": parent, "data": data, **note}
        try:
            stream = self._fs.create(self._path(f"{self.root}/manifest/{version:012d}.json"), False)
        except Exception as e:  # py4j wraps the file system's refusal
            if "already exist" in str(e).lower():
                raise GateError("stale_parent") from e
            raise
        try:
            stream.write(bytearray(json.dumps(entry, ensure_ascii=False, sort_keys=True).encode("utf-8")))
        finally:
            stream.close()
        return version


def preview(snapshots: Snapshots, groups: Sequence[Mapping], actions: Sequence[Mapping]) -> dict:
    """What an approval refers to: fingerprints of the statement and of the version that it was previewed on."""
    statement = json.dumps({"where": list(groups), "set": list(actions)}, ensure_ascii=False, sort_keys=True)
    parent = snapshots.version()
    one = snapshots.spark.range(1).select(
        F.sha2(F.lit(statement), 256).alias("sql"), F.sha2(F.lit(f"{parent}:{statement}"), 256).alias("preview")).first()
    return {"parent": parent, "sql_fingerprint": one.sql, "preview_fingerprint": one.preview,
            "validation_status": "passed", "preview_status": "pending_user_confirmation"}


def _gate(seen: Mapping, approval: Mapping, spark: SparkSession) -> None:
    """M7 on one preview and its approval."""
    previews = spark.createDataFrame(
        [(1, seen["validation_status"], seen["preview_status"], seen["sql_fingerprint"], seen["preview_fingerprint"])],
        "step int, validation_status string, preview_status string, sql_fingerprint string, preview_fingerprint string")
    approvals = spark.createDataFrame(
        [(1, bool(approval.get("approved")), approval.get("sql_fingerprint"), approval.get("preview_fingerprint"))],
        "step int, approved boolean, approved_sql_fingerprint string, approved_preview_fingerprint string")
    if not MU.gate_check(previews, approvals, ["step"]).first()["can_execute"]:
        raise GateError("not_approved")


def gated_update(snapshots: Snapshots, groups: Sequence[Mapping], where: Column, actions: Sequence[Mapping], approval: Mapping,
                 scope: str, table: str, protected: Sequence[str] = (), id_col: str = "row_id") -> int:
    """M1 under all its gates; returns the new version.

    The predicate must be one (M9), targets unprotected (J8), the preview approved on the
    version that is still the latest (M7), and every affected row backed up (M3), which is
    read back and counted, before the new snapshot is published."""
    MU.require_predicate(groups)
    seen = preview(snapshots, groups, actions)
    if approval.get("parent") != seen["parent"]:
        raise GateError("stale_parent")
    _gate(seen, approval, snapshots.spark)
    df = snapshots.read()
    updated = MU.apply_update(df, where, actions, protected)
    affected = df.where(where)
    if not affected.where(F.col(id_col).isNull()).isEmpty():
        raise GateError("raw_update_backup_requires_row_id")
    rows = MU.backup_rows(df, where, scope, table, existing=snapshots.backups(), id_col=id_col)
    rows.write.mode("append").parquet(f"{snapshots.root}/backups")
    require_coverage(affected, snapshots.backups(), scope, table, id_col)
    return snapshots.publish(updated, seen["parent"], {"operation": "update", "scope": scope, "table": table,
                                                       "sql_fingerprint": seen["sql_fingerprint"]})


def require_coverage(affected: DataFrame, backups: DataFrame | None, scope: str, table: str, id_col: str = "row_id") -> None:
    """Every affected row has a backup of this scope, or nothing is published."""
    if backups is None or not MU.backup_coverage(affected, backups, scope, table, id_col).first()["complete"]:
        raise GateError("raw_update_backup_incomplete")


def gated_rollback(snapshots: Snapshots, scope: str, table: str, columns: Sequence[str], id_col: str = "row_id") -> int:
    """M4 as a further version: the rows of a scope as they were backed up."""
    parent, backups = snapshots.version(), snapshots.backups()
    if backups is None:
        raise GateError("no_backup")
    own = backups.where((F.col("backup_scope") == scope) & (F.col("target_table") == table))
    return snapshots.publish(MU.rollback(snapshots.read(), own, columns, id_col), parent, {"operation": "rollback", "scope": scope, "table": table})
