"""Named queries over the supplied tables, each with its SQL twin where SQL can say it."""

from importlib import import_module

MODULES = ("queries_raw", "queries_features", "queries_models", "queries_asof", "queries_cost",
           "queries_streaming")


def load_all():
    """Import every query module and return the filled registry."""
    for m in MODULES:
        import_module(f"wattloom.plans.{m}")
    from wattloom.plans.registry import REGISTRY
    return REGISTRY
