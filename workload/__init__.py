"""Registered queries over the driver's tables."""

from importlib import import_module

MODULES = ("quality", "lake", "gold", "scoring", "ranking", "messages")


def load_all():
    from workload import registry

    for name in MODULES:
        import_module(f"workload.{name}")
    return registry.QUERIES, registry.ORACLES
