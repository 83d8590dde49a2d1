"""Operators of a training-data pipeline: sharding, deduplication, search, extraction, tokens, quality and mixing.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` gather what its modules register.
"""

from __future__ import annotations

import importlib

#: Modules that register a query, in the order of their numbers.
MODULES = (
    "sharding",
    "simhash",
    "nndescent",
    "tagpaths",
    "sstable",
    "pieces",
    "rules",
    "classifier",
    "katz",
    "mixing",
)


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"{__name__}.{name}"), what, {}))
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
