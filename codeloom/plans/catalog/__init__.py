"""Registered queries and, where SQL can say it, what they must return.

Every module has QUERIES (name -> function of session and data folder) and ORACLES
(name -> SQL over the same tables).
"""

from __future__ import annotations

from codeloom.plans.catalog import (
    declarations, functions, links, model, search, sources, streams,
)

_MODULES = (sources, functions, declarations, links, search, model, streams)


def all_queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
