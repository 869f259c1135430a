"""The query catalogue: each entry runs an operator over the given tables, most with SQL to check it by."""

from __future__ import annotations

from importlib import import_module

from colsight.plans.catalog.base import QUERIES, SQL

MODULES = ("profiles", "cleaning", "charts", "filters", "models", "texts", "reports", "files", "streams")

for _name in MODULES:
    import_module(f"{__name__}.{_name}")

__all__ = ["QUERIES", "SQL"]
