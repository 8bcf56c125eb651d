"""Queries bound to the given tables."""

import importlib
import pkgutil


def load_all():
    """Import every query module and return the registry, sorted by name."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from trialspark.plans.registry import QUERIES
    return dict(sorted(QUERIES.items()))
