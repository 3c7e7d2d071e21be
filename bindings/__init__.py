"""Binds the operators to the given tables and registers one query per operator."""

from __future__ import annotations

import importlib

PARTS = ("cleaning", "sources", "filters", "matching", "similar", "evidence", "ranking", "jobs", "streams")


def load_all():
    """Queries and oracles of all parts."""
    from . import registry

    for part in PARTS:
        importlib.import_module(f"bindings.{part}")
    return registry.QUERIES, registry.ORACLES
