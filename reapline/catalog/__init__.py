"""Registered queries over the supplied tables, with equivalent SQL where there is one."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pages", "traces", "runs", "quality", "search", "access", "steps", "streams", "contracts", "lookups")


def load_all():
    """(queries, sql) of all catalog modules."""
    for name in MODULES:
        import_module(f"reapline.catalog.{name}")
    from reapline.catalog.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
