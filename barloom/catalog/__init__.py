"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "ingest",
    "cleaning",
    "validation",
    "scalars",
    "windows",
    "recursive",
    "labels",
    "signals",
    "trades",
    "metrics",
    "joins",
    "risk",
    "models",
    "streams",
)


def load():
    """All registered queries: name -> (callable, sql or None)."""
    for m in MODULES:
        import_module(f"barloom.catalog.{m}")
    from barloom.catalog.base import REGISTRY

    return REGISTRY
