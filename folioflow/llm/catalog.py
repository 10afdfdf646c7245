"""Registry of this subpackage's queries and of the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("groups", "splits", "sample", "overlap", "tokens", "leaks", "subjects")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"folioflow.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
