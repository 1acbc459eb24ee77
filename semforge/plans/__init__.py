"""Query plans over the driver's tables; each module registers its own."""

from __future__ import annotations

from importlib import import_module

MODULES = ("shares", "filters", "aggregates", "process", "semantics", "more", "rest")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
