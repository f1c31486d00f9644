"""Queries over the driver's tables, each beside its SQL where it has one."""

from __future__ import annotations

from importlib import import_module

from gridcast.queries.registry import ORACLE, QUERIES

for _part in ("timegrid", "cleaning", "joining", "files", "summaries", "scaling", "sampling", "sequences", "learning", "boosting", "grams", "flows"):
    import_module(f"gridcast.queries.{_part}")

__all__ = ["ORACLE", "QUERIES"]
