"""Linked step plans: closure against a Python BFS, validation fixtures."""

from __future__ import annotations

from tabvet.plans import steps as L
from tabvet.sources.derived import plan_steps

SCHEMA = ("plan_id long, step_key string, step_order int, intent_type string, dependency_type string, "
          "depends_on array<string>, step_status string")


def _bfs(edges):
    out = set()
    by = {}
    for p, s, d in edges:
        by.setdefault((p, s), set()).add(d)
    for (p, s) in by:
        seen, todo = set(), list(by[(p, s)])
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            todo.extend(by.get((p, x), ()))
        out |= {(p, s, a) for a in seen}
    return out


def test_closure_matches_bfs(spark, sf):
    edges = L.plan_edges(plan_steps(spark, sf))
    got = {tuple(r) for r in L.transitive_closure(edges).collect()}
    assert got == _bfs([tuple(r) for r in edges.collect()])


def test_validation_fixture(spark):
    rows = [
        (1, "s1", 1, "UPDATE_NUMERIC_VALUE", "independent", [], "accepted"),
        (1, "s2", 2, "SELECT_AGGREGATE", "dependent", ["s1"], "accepted"),
        (1, "s3", 3, "SELECT_AGGREGATE", "dependent", ["s1", "s2"], "pending"),  # diamond
        (1, "s4", 4, "SELECT_DETAIL", "dependent", ["s4"], "pending"),  # self
        (1, "s5", 5, "SELECT_DETAIL", "dependent", ["s9"], "pending"),  # missing
        (1, "s6", 6, "SELECT_DETAIL", "dependent", ["s7"], "pending"),  # order violation
        (1, "s7", 7, "SELECT_DETAIL", "dependent", [], "pending"),  # dependent without deps
        (1, "s7", 8, "SELECT_DETAIL", "independent", ["s1"], "cancelled"),  # duplicate id + warning
        (2, "solo", 1, "SELECT_DETAIL", "dependent", [], "pending"),  # single-step plan: not checked
    ]
    steps = spark.createDataFrame(rows, SCHEMA)
    errs = {(r["step_key"], r["error_code"]) for r in L.step_plan_validation(steps).collect()}
    assert ("s7", "linked_step_duplicate_id") in errs
    assert ("s4", "linked_step_self_dependency") in errs
    assert ("s5", "linked_step_missing_dependency") in errs
    assert ("s6", "linked_step_dependency_order_violation") in errs
    assert ("s7", "linked_step_dependent_without_depends_on") in errs
    assert ("s7", "linked_step_independent_has_depends_on") in errs
    assert not any(k == "solo" for k, _ in errs)
    avail = {(r["step_order"]): r["available"] for r in L.step_availability(steps).collect() if r["plan_id"] == 1}
    assert avail[2] is True and avail[3] is True and avail[4] is False and avail[8] is False
    closure = L.transitive_closure(L.plan_edges(steps))
    inv = {r["step_key"] for r in L.steps_to_invalidate(closure, steps, "s1", "dependents").where("plan_id = 1").collect()}
    assert inv == {"s1", "s2", "s3", "s6", "s7"}  # s6 -> s7 (second copy) -> s1
    counts = {r["plan_id"]: (r["step_count"], r["dependent_step_count"]) for r in L.plan_counts(steps).collect()}
    assert counts[1] == (8, 6)
