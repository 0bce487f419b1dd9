"""Set-based re-expressions against plain-Python procedures of the same rules."""

from __future__ import annotations

import unicodedata
from collections import Counter

from tabvet.operators import catalog as C
from tabvet.plans import steps as L
from tabvet.queries import q_quality as QQ
from tabvet.sources.derived import plan_steps
from tabvet.sources.tables import stg_k


def _norm(v: str) -> str:
    return "".join(unicodedata.normalize("NFC", v).lower().split())[:512]


def test_value_catalog_collision_rule(spark, sf):
    df = stg_k(spark, sf)
    rows = [r.asDict() for r in df.collect()]
    expected = {}
    for col in [c for c in df.columns if c != "row_id"]:
        freq = Counter(str(r[col]) for r in rows if r[col] is not None and str(r[col]).strip() != "")
        top = sorted(freq.items(), key=lambda kv: (-kv[1], kv[0]))[:50]
        for raw, f in top:  # processed in order; a later (rarer) value overwrites the key
            expected[(col, _norm(raw))] = (raw, f)
    got = {(r.column_name, r.normalized_value): (r.raw_value, r.frequency) for r in C.value_catalog(df, "SA").collect()}
    assert got == expected


def test_pass_streaks_match_loop(spark, sf):
    metrics = QQ._metrics(spark, sf).collect()
    got = {(r.model, r.run): (r.passed, r.streak) for r in QQ.pass_streaks(spark, sf).collect()}
    by_model: dict = {}
    for m in metrics:
        by_model.setdefault(m.model, {}).setdefault(m.run, []).append(m.pass_rate)
    for model, runs in by_model.items():
        streak = 0
        for run in sorted(runs):
            avg = round(sum(runs[run]) / len(runs[run]), 6)
            passed = avg > QQ.STREAK_THRESHOLD
            streak = streak + 1 if passed else 0
            assert got[(model, run)] == (passed, streak), (model, run)


def test_plan_validation_matches_procedure(spark, sf):
    steps = plan_steps(spark, sf)
    rows = steps.orderBy("plan_id", "step_order").collect()
    plans: dict = {}
    for r in rows:
        plans.setdefault(r.plan_id, []).append(r)
    expected = set()
    for pid, plan in plans.items():
        if len(plan) <= 1:
            continue
        ids = [s.step_key for s in plan]
        known = set(ids)
        for dup in {i for i in ids if ids.count(i) > 1}:
            expected.add((pid, dup, "linked_step_duplicate_id", None))
        seen: set = set()
        for s in plan:
            deps = list(s.depends_on)
            if s.step_key in deps:
                expected.add((pid, s.step_key, "linked_step_self_dependency", None))
            for d in deps:
                if d not in known:
                    expected.add((pid, s.step_key, "linked_step_missing_dependency", d))
                elif d not in seen:
                    expected.add((pid, s.step_key, "linked_step_dependency_order_violation", d))
            if s.dependency_type == "dependent" and not deps:
                expected.add((pid, s.step_key, "linked_step_dependent_without_depends_on", None))
            if s.dependency_type == "independent" and deps:
                expected.add((pid, s.step_key, "linked_step_independent_has_depends_on", None))
            seen.add(s.step_key)
    got = {(r.plan_id, r.step_key, r.error_code, r.detail) for r in L.step_plan_validation(steps).collect()}
    assert got == expected
