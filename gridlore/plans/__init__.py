"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of this package, which registers its queries."""
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
