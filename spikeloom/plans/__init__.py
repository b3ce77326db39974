"""Registered queries. Importing a module adds its queries to the registry."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
