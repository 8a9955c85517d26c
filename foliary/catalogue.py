"""All queries of the core, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "rows", "files")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"foliary.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"foliary.plans.{m}").SQL.items()}
