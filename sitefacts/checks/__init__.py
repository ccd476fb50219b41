"""Queries by name with their SQL counterparts; see ``base`` for the registry."""

from __future__ import annotations

import importlib

MODULES = ("urls", "columns", "pages", "extract", "tables", "people", "markdown")


def load():
    for name in MODULES:
        importlib.import_module(f"sitefacts.checks.{name}")
    from sitefacts.checks.base import QUERIES

    return QUERIES


def oracles():
    load()
    from sitefacts.checks.base import ORACLES

    return ORACLES
