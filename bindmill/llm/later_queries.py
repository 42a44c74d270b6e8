"""Registered queries of the operators from op11 on, which are not part of the first ten."""

from __future__ import annotations

from importlib import import_module

MODULES = ("whitening", "clustering", "packing")


def _modules() -> list:
    return [import_module(f"bindmill.llm.{name}") for name in MODULES]


QUERIES = {name: query for module in _modules() for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
