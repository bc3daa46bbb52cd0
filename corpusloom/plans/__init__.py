"""Queries of the engine's own operators."""

import importlib

MODULES = ("url_queries", "text_queries", "host_queries", "link_queries", "recipe_queries", "section_queries")


def load():
    """All registered queries, and their SQL."""
    from corpusloom.plans import registry

    for m in MODULES:
        importlib.import_module(f"corpusloom.plans.{m}")
    return dict(registry.QUERIES), dict(registry.SQL)
