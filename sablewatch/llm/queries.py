"""All queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

from sablewatch.llm import registry

MODULES = ("repetition", "pieces", "attribution", "token_store", "ordinal", "line_dedup",
           "near_dedup", "repeats", "packing", "multi_index", "online_packing", "hard_negatives",
           "conversations")


def load_queries():
    """``(queries, oracles)`` of all operator modules."""
    for name in MODULES:
        import_module(f"sablewatch.llm.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
