"""Registered queries over the test tables."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every ``queries_*`` module so that it registers its queries."""
    for m in sorted(m.name for m in iter_modules(__path__)):
        if m.startswith("queries_"):
            import_module(f"{__name__}.{m}")
