"""Named queries (one per operator id of the survey) and their DuckDB oracles."""

from __future__ import annotations

import importlib

from .base import ORACLE, QUERIES

_MODULES = ["profiling", "quality", "prep", "features", "text", "ml"]


def load() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:  # area not written yet
            if e.name != f"{__name__}.{m}":
                raise


def queries():
    load()
    return dict(QUERIES)


def oracle_sql():
    load()
    return dict(ORACLE)
