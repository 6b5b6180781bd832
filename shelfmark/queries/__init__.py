"""All registered queries by name."""

from __future__ import annotations

from importlib import import_module

from .registry import Query

_MODULES = ("navigation", "search", "lookup", "upkeep", "extraction", "usage", "jobs")


def registered() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in _MODULES:
        found = import_module(f"{__name__}.{name}").queries.found
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        out.update(found)
    return out
