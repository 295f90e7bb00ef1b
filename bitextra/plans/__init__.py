"""Bound queries over the driver's tables."""

from importlib import import_module

# Modules whose import registers queries.
MODULES = ("text_queries", "numeric_queries", "glossary_queries", "access_queries", "joblog_queries", "unit_queries", "source_queries", "streaming_queries", "inference_queries")


def load_registry():
    for name in MODULES:
        import_module(f"bitextra.plans.{name}")
    from bitextra.plans.registry import REGISTRY

    return REGISTRY
