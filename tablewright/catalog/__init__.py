"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from tablewright.catalog.registry import ENTRIES, runner

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _module not in ("registry", "tables"):
        importlib.import_module(f"{__name__}.{_module}")


def queries():
    return {name: runner(e) for name, e in ENTRIES.items()}


def oracle_sql():
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}


def coverage() -> dict[str, list[str]]:
    """SURVEY row → names of the queries that cover it."""
    out: dict[str, list[str]] = {}
    for name, e in ENTRIES.items():
        for row in e.covers:
            out.setdefault(row, []).append(name)
    return out
