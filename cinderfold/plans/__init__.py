"""Registered queries."""

from __future__ import annotations

from types import ModuleType


def load() -> ModuleType:
    """The registry, filled by the modules that register queries."""
    from cinderfold.plans import catalogue, corpus_queries, registry, source_queries  # noqa: F401

    return registry
