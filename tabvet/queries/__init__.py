"""Registered queries, one per operator id of the inventory."""

from __future__ import annotations

import importlib

MODULES = [
    "q_filters",
    "q_aggs",
    "q_projections",
    "q_plans",
    "q_overlay",
    "q_mutation",
    "q_ingest",
    "q_joins",
    "q_catalog",
    "q_text",
    "q_quality",
    "q_streaming",
    "q_sources",
    "q_sinks",
]


def load_all():
    for m in MODULES:
        importlib.import_module(f"tabvet.queries.{m}")
    from tabvet.queries.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
