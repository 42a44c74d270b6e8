"""Registered queries of the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "mixing", "pii", "urls", "quality_rules", "decontamination", "token_counts", "quality_model",
           "near_duplicates", "repeats")


def _modules() -> list:
    return [import_module(f"bindmill.llm.{name}") for name in MODULES]


QUERIES = {name: query for module in _modules() for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
