"""Queries over the test tables, one for each operator."""

from __future__ import annotations

import importlib

MODULES = ("conditions", "rules", "graph", "history", "inspection", "streams", "reconcile")


def load_all() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"evenkeel.plans.{name}")
