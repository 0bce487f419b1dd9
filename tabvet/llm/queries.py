"""Every registered query of the subpackage."""

from __future__ import annotations

import importlib

MODULES = ["q_tokens", "q_mixing", "q_quality", "q_duplicates", "q_pages", "q_pii", "q_search"]


def load():
    for m in MODULES:
        importlib.import_module(f"tabvet.llm.{m}")
    from tabvet.llm.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
