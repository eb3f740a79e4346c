"""Registered queries, their oracle SQL, and multi-operator page plans."""

from __future__ import annotations

import importlib

_MODULES = [
    "catalog_queries",
    "event_queries",
    "text_queries",
    "vector_queries",
    "raster_queries",
    "iterative_queries",
    "source_queries",
]


def all_queries() -> dict:
    """Every registered query by name."""
    from draftlake.plans.registry import QUERIES

    for module in _MODULES:
        importlib.import_module(f"draftlake.plans.{module}")
    return QUERIES
