"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

AREAS = ("anomaly_queries", "series_queries", "line_queries", "extraction_queries", "memory_queries", "dump_queries", "agent_queries", "tree_queries", "more_queries")


def collect(attribute: str) -> dict:
    found: dict = {}
    for area in AREAS:
        found.update(getattr(import_module(f"logquarry.plans.{area}"), attribute))
    return found
