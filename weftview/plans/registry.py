"""All registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = ("structure", "render", "linkq", "sessions", "viewq", "streamq")


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"weftview.plans.{m}")
        out.update(getattr(mod, attr, {}))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
