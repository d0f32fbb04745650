"""Every operator as a query over the driver's tables, with its SQL oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ("detection", "statistics", "sources_view", "signals", "corpus", "streams")


def load_catalog():
    """``(queries, oracles)`` of all query modules."""
    from sablewatch.catalog import registry

    for name in MODULES:
        import_module(f"sablewatch.catalog.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
