"""Query plans: derived views, and the registered queries with their SQL."""

import importlib

MODULES = ("scalars", "joins", "aggregates", "ordering", "spatial", "mutation", "imports", "streams", "lookups", "scenes", "routes", "venues", "stores", "builds", "compiling", "centerlines", "references")


def all_queries():
    """All registered queries by name."""
    for m in MODULES:
        importlib.import_module(f"floorspan.plans.{m}")
    from floorspan.plans.registry import REGISTRY

    return REGISTRY
