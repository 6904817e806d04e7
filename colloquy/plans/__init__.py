"""Views over the tables and the catalog of runnable queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every ``catalog_*`` module once and return (queries, SQL)."""
    from colloquy.plans import registry

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("catalog_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
