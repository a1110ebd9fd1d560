"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["quality", "vectors", "labels", "types", "files", "models"]


def load() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        importlib.import_module(f"workload.{module}")
